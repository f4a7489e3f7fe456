"""stemma: a PySpark engine for corpora of damaged and edited texts."""
