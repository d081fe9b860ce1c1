"""Word lists and patterns whose values must equal the reference behaviour.

Everything below is a fixed value (lexicon, pattern, list) stated plainly and in
its natural order; the rule engines in ``functions/rules.py`` compile these into
Column expressions.
"""

# ---------------------------------------------------------------------------
# Theme lexicon of the SQL seed (C3), first match wins, in order.
# ---------------------------------------------------------------------------
THEMES_SQL = [
    ("billing", "(invoice|billing|payment|charge|refund|pricing|price|plan cost|renewal)"),
    ("search", "(search|find|discover|browse)"),
    ("integrations", "(api|integration|webhook|import|export|sso|sync|connect)"),
    ("reporting", "(report|dashboard|analytics|metric|chart|export)"),
    ("collaboration", "(collaborat|team|share|permission|role|access|multi-user)"),
    ("onboarding", "(onboard|setup|getting started|tutorial|learn|training|documentation|docs)"),
    ("support", "(support|help|cs|assistance|response time|reply)"),
    ("mobile", "(mobile|iphone|android|app)"),
    ("performance", "(performance|speed|fast|slow|lag|latency)"),
    ("product_quality", "(bug|crash|error|broken|glitch|outage|freeze|stuck|down)"),
]

# Sentiment words of the SQL seed (C4); positive tested first.
SENTIMENT_SQL_POSITIVE = "(great|love|excellent|amazing|awesome|happy|impressed|best|easy|fast)"
SENTIMENT_SQL_NEGATIVE = "(bad|worst|terrible|hate|awful|frustrat|disappoint|annoy|angry|unhappy|slow|broken|bug)"

# ---------------------------------------------------------------------------
# Theme lexicon of the enrichment step (C5); billing adds itemized.
# ---------------------------------------------------------------------------
THEMES_ENRICHED = [
    ("billing", "(invoice|billing|payment|charge|refund|pricing|price|plan cost|renewal|itemized)"),
    ("search", "(search|find|discover|browse)"),
    ("integrations", "(api|integration|webhook|import|export|sso|sync|connect)"),
    ("reporting", "(report|dashboard|analytics|metric|chart|export)"),
    ("collaboration", "(collaborat|team|share|permission|role|access|multi-user)"),
    ("onboarding", "(onboard|setup|getting started|tutorial|learn|training|documentation|docs)"),
    ("support", "(support|help|cs|assistance|response time|reply)"),
    ("mobile", "(mobile|iphone|android|app)"),
    ("performance", "(performance|speed|fast|slow|lag|latency)"),
    ("product_quality", "(bug|crash|error|broken|glitch|outage|freeze|stuck|down)"),
]

# Sentiment words of the enrichment step.
SENTIMENT_POSITIVE = (
    "(great|love|excellent|amazing|awesome|happy|impressed|best|easy|fast|good|nice|works well|seamless)"
)
SENTIMENT_NEGATIVE = (
    "(bad|worst|terrible|hate|awful|frustrat|disappoint|annoy|angry|unhappy|slow|broken|bug|crash|error"
    "|fails?|downtime)"
)

# ---------------------------------------------------------------------------
# Ticket / event / churn configuration tables.
# ---------------------------------------------------------------------------
TICKET_CATEGORIES = [
    ("billing", "Billing / payments / invoices"),
    ("bug", "Product bug or crash"),
    ("feature_request", "Requested feature or enhancement"),
    ("general_question", "General product question"),
    ("technical_issue", "Technical problem"),
    ("onboarding", "Onboarding / setup help"),
    ("account_access", "Account / login / access"),
]
TICKET_PRIORITIES = [("urgent", "Urgent"), ("high", "High"), ("medium", "Medium"), ("low", "Low")]
TICKET_STATUSES = [("open", "Open (unresolved)"), ("pending", "Pending (awaiting response)"),
                   ("resolved", "Resolved")]
EVENT_TYPES = [("cancellation", "Plan cancelled"), ("downgrade", "Plan downgraded"),
               ("upgrade", "Plan upgraded"), ("renewal", "Plan renewed")]
CHURN_STATUSES = [("canceled", "Subscription cancelled"), ("paused", "Subscription paused")]

# ---------------------------------------------------------------------------
# Input guardrail patterns (G3). High confidence blocks,
# suspicious flags. Matching is case-insensitive.
# ---------------------------------------------------------------------------
INJECTION_HIGH = [
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?)",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?)",
    r"you\s+are\s+now\s+",
    r"act\s+as\s+if\s+you\s+are\s+",
    r"(reveal|show|print|output|leak)\s+(your\s+)?(system\s+)?prompt",
    r"system\s+prompt",
    r"forget\s+(all\s+)?(your|the)\s+(instructions?|rules?|prompts?)",
    r"new\s+(instructions?|rules?)\s*:",
    r"<\|?(system|im_start|im_end)\|?>",
]
INJECTION_SUSPICIOUS = [
    r"do\s+not\s+(tell|mention|say)\s+(anyone|the\s+user|them)",
    r"pretend\s+",
    r"role\s+play",
    r"jailbreak",
    r"developer\s+mode",
    r"override",
    r"ignore\s+",
    r"regardless\s+of\s+(your|the)\s+(instructions?|rules?)",
]
MAX_INPUT_CHARS = 4000

# PII patterns (G9). ``\w``/``\d`` are spelled as ASCII classes so
# the JVM and RE2 engines agree (documented deviation from Unicode-aware Python).
PII_PATTERNS = [
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"),
    ("phone", r"(\+?[0-9]{1,3}[\s.-]?)?(\(?[0-9]{3}\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}"),
    ("credit_card", r"\b(?:[0-9][ -]*?){13,16}\b"),
]

# Messages of the checks (G1-G10), which their readers know; %d is a number, {cap} the limit
MESSAGES = {
    "input_ok": "Input is a string.",
    "input_missing": "Input must be a string (got NoneType).",
    "length_ok": "Input length %d <= {cap}.",
    "length_over": "Input too long (%d chars; cap {cap}).",
    "injection_block": "Prompt-injection pattern detected.",
    "injection_flag": "Suspicious prompt-injection pattern.",
    "injection_ok": "No injection patterns detected.",
    "moderation_off": "Moderation pre-check disabled (MODERATION_ENABLED=false).",
    "moderation_skipped": "Moderation skipped (unavailable); deterministic checks still apply.",
    "moderation_block": "Moderation flagged the input as unsafe.",
    "moderation_ok": "Moderation passed.",
    "schema_ok": "Answer matches AnswerSchema.",
    "schema_bad": "Answer failed schema validation: ",
    "confidence_low": "Insufficient data — confidence forced to low.",
    "confidence_ok": "Confidence is grounded.",
    "citations_bad": "Facts section(s) with no record-id citations.",
    "citations_ok": "All Facts sections cite records.",
    "pii_bad": "PII pattern detected in answer.",
    "pii_ok": "No PII patterns detected.",
    "render_bad": "Unknown render_hint.kind — falling back to markdown.",
}

# Render kinds, confidence levels
RENDER_KINDS = ["table", "chart", "qa", "cards", "markdown"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]

# Tool registry with allowed argument names
TOOL_REGISTRY = [
    ("get_customer_profile", ["customer_id"]),
    ("rank_customer_risk", ["limit", "segment", "status"]),
    ("calculate_revenue_at_risk", ["segment"]),
    ("get_customer_tickets", ["customer_id", "limit", "category", "priority", "status"]),
    ("get_customer_feedback", ["customer_id", "limit"]),
    ("get_feedback_themes", ["min_count", "segment"]),
    ("get_ticket_breakdown", ["segment"]),
    ("get_usage_change", ["customer_id", "segment"]),
    ("get_usage_trend", ["customer_id", "weeks"]),
    ("get_subscription_events", ["customer_id", "limit"]),
    ("calculate_segment_metrics", ["segment"]),
    ("list_customers", ["segment", "status", "limit", "search"]),
    ("resolve_customer_name", ["name"]),
    ("semantic_query", ["query"]),
    ("get_catalog", []),
    ("retrieve_sources", ["query", "k", "filters", "rerank_enabled"]),
    ("read_memory", ["key"]),
    ("write_memory", ["key", "value"]),
    ("list_memory", []),
]

# ---------------------------------------------------------------------------
# Question classification (H1-H8)
# ---------------------------------------------------------------------------
ID_PATTERNS = [
    ("customer_ids", r"(?i)\bCUST-[0-9]{3,}\b"),
    ("ticket_ids", r"(?i)\bTCK-[0-9]{3,}\b"),
    ("feedback_ids", r"(?i)\bFDB-[0-9]{3,}\b"),
]
SEGMENTS = ["smb", "mid-market", "enterprise"]
PLANS = ["free", "team", "business", "enterprise"]
DATE_PHRASES = ["last 4 weeks", "last four weeks", "last month", "this month", "last week", "this week",
                "last 8 weeks", "last 3 months"]
NAME_STOP_WORDS = [
    "a", "an", "the", "and", "or", "of", "for", "with", "about", "what", "who",
    "which", "how", "many", "much", "show", "tell", "give", "me", "is", "are",
    "was", "were", "customer", "customers", "ticket", "tickets", "feedback",
    "usage", "trend", "risk", "revenue", "segment", "plan", "country", "churn",
    "open", "count", "total", "by", "in", "at", "on", "from", "last", "week",
    "month", "their", "they", "has", "have", "had", "been", "being", "do",
    "does", "did", "can", "could", "would", "should", "please", "all", "any",
    "most", "top", "high", "low", "status", "active", "paused", "canceled",
    "enterprise", "smb", "mid-market", "business", "free", "team",
    "find", "look", "search", "list", "get", "why", "where", "when", "hello", "hi", "hey",
    "there", "will", "may", "might", "must", "let", "make", "write", "create", "explain",
    "describe", "summarize", "compare", "analyze", "review", "check", "see", "help",
    "but", "so", "this", "that", "these", "those", "it", "its", "you", "your", "our", "we", "us",
    "them", "i", "my",
    "cust", "tck", "fdb",
]
CUSTOMER_KEYWORDS = ["customer", "account", "who is", "profile", "drill down", "drill-down"]
TICKET_KEYWORDS = ["ticket", "tickets", "support case", "issue", "bug report", "open cases"]
FEEDBACK_KEYWORDS = ["feedback", "review", "rating", "nps", "app store", "survey"]
THEME_KEYWORDS = ["theme", "themes", "sentiment", "complaint", "complaints", "what are customers saying",
                  "top problems", "common problems", "pain point", "pain points"]
ANALYTICS_KEYWORDS = ["segment", "segments", "compare", "comparison", "revenue at risk", "at-risk", "at risk",
                      "risk", "mrr", "churn", "cancel rate", "executive", "overview", "which segment",
                      "which plan", "prioritize", "priority", "most important", "biggest impact",
                      "what should we do", "recommend", "recommendation", "action", "actions"]
TREND_KEYWORDS = ["trend", "over time", "last 4 weeks", "last four weeks", "last month", "weekly", "daily",
                  "change", "increased", "decreased", "going up", "going down", "usage trend"]
RAG_KEYWORDS = ["mention", "said", "saying", "evidence", "find", "search", "look for", "what do customers",
                "quote", "comments", "mentions"]
IRRELEVANT_KEYWORDS = ["weather", "sports", "recipe", "cooking", "joke", "poem", "write a story", "who won",
                       "stock market", "bitcoin", "crypto price", "translate", "what is the capital",
                       "tell me a", "make me a", "your name", "who are you", "what can you do", "are you human"]
# (intent, keywords, specificity) in the order used for ties
INTENT_LEXICONS = [
    ("theme_sentiment", THEME_KEYWORDS, 5),
    ("analytics_exec", ANALYTICS_KEYWORDS, 4),
    ("trend", TREND_KEYWORDS, 4),
    ("customer_query", CUSTOMER_KEYWORDS, 2),
    ("ticket_query", TICKET_KEYWORDS, 3),
    ("feedback_query", FEEDBACK_KEYWORDS, 3),
    ("free_text_rag", RAG_KEYWORDS, 1),
]
ROUTES = [
    ("customer_query", "customer"), ("ticket_query", "themes"), ("feedback_query", "themes"),
    ("theme_sentiment", "themes"), ("analytics_exec", "analytics"), ("trend", "trend"),
    ("free_text_rag", "rag"), ("general", "general"), ("irrelevant", "blocked"),
]
NODE_TOOLS = [
    ("customer", ["get_customer_profile", "get_customer_tickets", "get_customer_feedback", "get_usage_change",
                  "get_subscription_events", "get_usage_trend"]),
    ("themes", ["retrieve_sources", "get_feedback_themes", "get_ticket_breakdown"]),
    ("analytics", ["calculate_segment_metrics", "rank_customer_risk", "calculate_revenue_at_risk",
                   "list_customers", "semantic_query"]),
    ("trend", ["get_usage_trend", "get_usage_change", "get_ticket_breakdown"]),
    ("rag", ["retrieve_sources", "get_feedback_themes", "get_ticket_breakdown", "semantic_query"]),
    ("general", ["get_customer_profile", "get_customer_feedback", "get_feedback_themes", "get_ticket_breakdown",
                 "get_usage_change", "rank_customer_risk", "calculate_revenue_at_risk", "retrieve_sources",
                 "semantic_query"]),
]
# question -> requested metric (H8); first hit wins, in this order
ENTITY_WORDS = [
    ("customer", "customer"), ("customers", "customer"), ("account", "customer"), ("accounts", "customer"),
    ("ticket", "ticket"), ("tickets", "ticket"), ("feedback", "feedback"), ("reviews", "feedback"),
    ("usage", "usage"), ("session", "usage"), ("sessions", "usage"),
    ("subscription", "subscription_event"), ("subscriptions", "subscription_event"),
    ("plan change", "subscription_event"),
]
DIMENSION_WORDS = [
    ("country", "country"), ("countries", "country"), ("segment", "customer_segment"),
    ("segments", "customer_segment"), ("plan", "subscription_plan"), ("plans", "subscription_plan"),
    ("status", "account_status"), ("category", "category"), ("priority", "priority"),
    ("source", "feedback_source"), ("feature", "feature_usage"),
]
METRIC_WORDS = [("count", "count"), ("how many", "count"), ("total", "count"), ("number of", "count"),
                ("average", "avg"), ("avg", "avg"), ("mean", "avg"), ("sum", "sum"), ("revenue", "sum")]
DEFAULT_NUMERIC_DIM = [("customer", "monthly_revenue"), ("ticket", "resolution_time_hours"),
                       ("feedback", "rating"), ("usage", "sessions"), ("subscription_event", "revenue_change")]

# Record id pattern used by the evaluator
RECORD_ID_PATTERN = r"\b(?:CUST|TCK|FDB)-[0-9]+\b"
