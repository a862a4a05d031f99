"""Reports as text, from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, rows: int = 1_000) -> str:
    """Rows as aligned columns; what is beyond ``rows`` is counted at the end."""
    got = df.limit(rows + 1).collect()
    head = [df.columns] + [["-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in got[:rows]]
    width = [max(len(r[c]) for r in head) for c in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in head]
    return "\n".join(lines + ([f"... and {df.count() - rows} more"] if len(got) > rows else []))


def ingest(statistics: DataFrame, summary: DataFrame) -> str:
    """Pages with sections, chunks and words; then the sizes of chunks."""
    s = summary.first()
    return f"{table(statistics.orderBy('url'))}\n{s.chunks} chunks, tokens: mean {s.mean:.0f}, median {s.median:.0f}, {s.least:.0f} to {s.most:.0f}"


def index(counts: dict[str, int], documents: int, chunks: int) -> str:
    states = ", ".join(f"{counts.get(k, 0)} {k}" for k in ("new", "changed", "unchanged", "removed"))
    return f"Pages: {states}. Index: {documents} pages, {chunks} chunks."


def evaluation(grouped: DataFrame, missed: DataFrame) -> str:
    """Metrics by group, then the questions without an answer."""
    return f"{table(grouped.orderBy('dimension', 'value'))}\n\nMissed:\n{table(missed.orderBy('qid'))}"


def sources(cited: DataFrame) -> str:
    """Cited sections with their numbers, in order of the first."""
    return "\n".join(f"[{r.numbers}] {r.section} {r.url}" for r in cited.orderBy("first").toLocalIterator())


def agent(rates: DataFrame, checked: DataFrame, checks: tuple[str, ...]) -> str:
    """Rates of the checks by set, then the runs that fail one, with what they fail."""
    from pyspark.sql import functions as F

    failed = F.array_join(F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c.removesuffix("_ok"))) for c in checks))), ", ")
    bad = checked.select("id", failed.alias("fails")).where("fails <> ''")
    return f"{table(rates.orderBy('group', 'check'))}\n\nFailed:\n{table(bad.orderBy('id'))}"
