"""Small tables with every odd case: nulls, empty, blank and long texts, ties, repeated rows."""

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potent magic under pale moonlight near the old stone bridge".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"{WORDS[(x >> 8) % len(WORDS)]}{(x >> 16) % 7}")
    return " ".join(out)


def odd_rows() -> list[tuple]:
    rows = [(i, prose(i, 20 + 13 * i), ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None) for i in range(30)]
    rows += [(100, None, None, None), (101, "", "en", "src1"), (102, " \n\t ", "en", "src1"), (103, "one", "en", "src1"), (104, "ü 漢字 😀", "xx", "src2")]
    rows += [(105, rows[3][1], "en", "src3"), (106, rows[3][1], "en", "src3"), (7, rows[7][1], "de", "src3"), (7, "another text of the same id", "de", "src3")]
    rows += [(None, "no id", "en", "src0"), (None, None, None, None), (-5, prose(99, 60_000), "en", "src0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """documents with clashing columns besides its own."""
    clash = ["size", "target", "taken", "copies", "shard", "slot", "fp", "key", "kind", "value", "score", "licenses", "spans", "items", "n_words", "hash", "id", "node", "component", "_row_"]
    rows = [(*r[:4], None if r[1] is None else len(r[1]), *(["x"] * len(clash))) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").repartition(3)
