"""All queries of this folder, and the pipeline at the top of the repository."""

import corpus_pipeline
from markbook.llm import brown, decontamination, html, langid, middle, near_duplicates, packing, phrases, secrets, suffixes, topk, toxicity, warc  # noqa: F401
from markbook.llm.common import QUERIES, SQL  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
