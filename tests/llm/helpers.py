"""Small document tables with the odd cases every operator must stand."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, words string, fp string, ids string"


def frame(spark, texts: list, ids: list | None = None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", None, -1.0, "w", "f", "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def odd_texts() -> list:
    return [
        None, "", " \t\n ", "one", "two words", "a b c", "a b c", "\n\n\n", "x" * 5000,
        "word " * 3000, "Ünïcode ЖЖ 中文 🙂 text\x00 with nul", "tail\n", "#$%^&*()",
    ]


def rows(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
