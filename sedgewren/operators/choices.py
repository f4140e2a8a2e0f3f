"""Choices between providers, stores and classifiers, and the labels that entries are shown with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.operators.topics import MOST_TOPICS

#: What a state of a fetch is called.
STATUS_LABELS = {
    "ok": "archived",
    "empty": "no readable text",
    "unsupported_type": "not HTML",
    "http_error": "server refused",
    "network_error": "unreachable",
    "timeout": "timed out",
    "blocked_by_robots": "crawling disallowed",
    "skipped": "not crawled",
    "not_crawled": "not crawled",
}
BATCH = 12


def resolve(preferred: str | None, configured: str | None, known: tuple[str, ...], able: bool, fallback: str = "local") -> str:
    """Of an embedding provider or vector store: the one asked for, then the one configured; any unknown name leaves the
    choice to whether the remote one (the last known) could be used."""
    asked = preferred if preferred is not None else configured
    if asked in known:
        return asked
    return known[-1] if able else fallback


@dataclass(frozen=True)
class VectorLeg:
    """Whether the vector leg of a search can run, and what is said if not."""

    usable: bool
    notice: str | None = None


def vector_leg(index_dimensions: int, query_dimensions: int, error: str | None = None) -> VectorLeg:
    """Vectors of different lengths, or a failing provider, leave the keyword leg alone with a notice."""
    if error is not None:
        return VectorLeg(False, f"Semantic search unavailable ({error}). Showing keyword results.")
    if index_dimensions != query_dimensions:
        return VectorLeg(False, f"Embedding dimension mismatch (index {index_dimensions}d, runtime {query_dimensions}d). Rebuild the index.")
    return VectorLeg(True)


def arbitrate(proposed: Column, picked: Column, slugs: Column, most: int = MOST_TOPICS) -> Column:
    """The first proposals that are known topics, in their order; without any, what scoring picked."""
    valid = F.filter(F.coalesce(proposed, F.array().cast("array<string>")), lambda s: F.array_contains(slugs, s))
    return F.when(F.size(valid) > 0, F.slice(valid, 1, most)).otherwise(picked)


def classify(rows: DataFrame, id_col: str, text_col: str, classifier: Callable[[list[tuple[str, str]]], dict[str, list[str]]], batch: int = BATCH) -> DataFrame:
    """id, topics as an outside classifier proposes them, asked in batches; null where it doesn't answer for an id.

    The classifier is a function from (id, text) pairs to topics by id; its errors fail the task, so that the caller can
    fall back to scoring for all rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                ids = part[id_col].astype(str).tolist()
                answers = classifier(list(zip(ids, part[text_col].fillna(""), strict=True)))
                yield pd.DataFrame({id_col: part[id_col], "topics": [answers.get(i) for i in ids]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, topics array<string>")


def status_label(status: Column) -> Column:
    """Display text of a fetch's state; unknown states are shown as they are."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), status)


def detail_label(site_name: Column, domain: Column) -> Column:
    """The site's name before the domain, unless they are the same."""
    named = (F.coalesce(site_name, F.lit("")) != "") & (F.lower(site_name) != F.lower(domain))
    return F.when(named, F.concat(site_name, F.lit(" · "), domain)).otherwise(domain)
