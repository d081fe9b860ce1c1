"""Plain Python statements of the contracts that SQL doesn't express."""

from __future__ import annotations

import hashlib
import re

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
               lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None, kinds: dict) -> tuple[list[int], str, str]:
    """Counts, hash and list of the base spans."""
    found = []
    for no, (kind, (pattern, good)) in enumerate(kinds.items()):
        found += [(m.start(), no, m.end(), kind) for m in re.finditer(pattern, text or "", re.ASCII) if good(m)]
    found.sort()
    line = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)
    counts = [sum(f[1] == no for f in found) for no in range(len(kinds))]
    return counts, hashlib.sha256(line.encode()).hexdigest(), line
