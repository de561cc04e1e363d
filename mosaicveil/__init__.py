"""mosaicveil: Spark-native detection and pseudonymisation of identifiers in text."""

from .operators.names import free_text_spans
from .operators.resolve import detect, span_rows
from .plans.redact import Redaction, redact_packages, redact_texts, self_audit
from .types import Config
from .vocab import VOCABULARY, Vocabulary

__all__ = ["VOCABULARY", "Config", "Redaction", "Vocabulary", "detect", "free_text_spans", "redact_packages", "redact_texts", "self_audit", "span_rows"]
