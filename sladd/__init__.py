"""sladd: find and mask personal data in tables, text corpora and markup with Spark.

Detection, scoring, overlap resolution, filtering and redaction are row-local
Column expressions, so a corpus is redacted in one scan without a shuffle.
"""

__version__ = "0.1.0"
