"""All queries of the analytics side and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import cleanup, corpus, facts, knowledge, layout, linking, mentions, names, relational, service, spelling, study, terms, topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus.QUERIES, **relational.QUERIES, **knowledge.QUERIES, **service.QUERIES, **study.QUERIES, **layout.QUERIES, **names.QUERIES, **terms.QUERIES, **spelling.QUERIES, **mentions.QUERIES, **facts.QUERIES, **cleanup.QUERIES, **linking.QUERIES, **topics.QUERIES}
ORACLES: dict[str, str] = {**corpus.ORACLES, **relational.ORACLES, **knowledge.ORACLES, **service.ORACLES, **study.ORACLES, **layout.ORACLES, **names.ORACLES, **terms.ORACLES, **spelling.ORACLES, **mentions.ORACLES, **facts.ORACLES, **cleanup.ORACLES, **linking.ORACLES, **topics.ORACLES}
