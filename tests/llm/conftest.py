import pytest

#: Columns that a careless operator might clash with.
EXTRA = ("fp", "rep", "key", "component_id", "node", "component", "base", "more", "k1", "k2", "spans", "score", "size", "target", "taken", "shard", "turn", "block", "host", "path", "rule", "verdict", "html2", "x", "n", "label2")


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        """documents from (doc_id, text[, source]) rows, with clashing columns if asked for."""
        full = [(i, t, "en", (s[0] if s else "a"), len(t) if t is not None else None, *([f"{i}"] * len(EXTRA) if extra else ())) for i, t, *s in rows]
        names = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in (EXTRA if extra else ()))
        return spark.createDataFrame(full, names)

    return make
