import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; inputs may have columns of the same names.
EXTRA = ("key", "row", "n", "class", "component", "n_words", "spans", "items", "failures", "kept", "n_dropped", "new_text", "gone", "pos",
         "_id", "_row", "_grouped", "_ROW_", "_hit", "_found", "_resolve", "print", "shard", "runs")


@pytest.fixture
def make_docs(spark):
    """Documents from {doc_id: text} or pairs, with further columns of clashing names."""

    def make(texts, extra=EXTRA):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in pairs]
        schema = ", ".join([DOC_SCHEMA, *(f"`{c}` string" for c in extra)])
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture
def words():
    import random

    def make(n, seed=0, size=5000):
        r = random.Random(seed)
        return ["w" + "".join(chr(97 + int(d)) for d in str(r.randrange(size))) + "x" for _ in range(n)]

    return make
