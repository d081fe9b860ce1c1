"""Import every registration module so QUERIES is complete."""

from churnlens.plans import registry  # noqa: F401
