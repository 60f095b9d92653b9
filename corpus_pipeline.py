"""The corpus pipeline: classify, judge, drop near copies, cut repeated passages, pack.

Every stage takes (session, documents, folder of the tables) and returns a table, which is
written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from quillmill.llm import stages

STAGES = stages.STAGES

ORACLE_SQL = None  # learned stages and the packing cannot be said in SQL

run = stages.run
