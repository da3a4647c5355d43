"""What the shingle join writes and shuffles."""

from pageloom.operators import similarity


def test_rows_of_shingles_are_numbers(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(40))
    posts = [(1, "s", text), (2, "s", text + " more"), (3, "t", text + " other"), (4, None, text), (5, None, text + " end"), (-6, "s", text + " last one")]
    stored = {}
    write = similarity.materialised

    def kept(df, name, *rest):
        stored[name] = write(df, name, *rest)
        return stored[name]

    monkeypatch.setattr(similarity, "materialised", kept)
    got = similarity.shingle_duplicates(spark.createDataFrame(posts, "id long, scope string, body string")).collect()
    assert sorted((r.scope, r.id_a, r.id_b) for r in got) == [("s", -6, 1), ("s", -6, 2), ("s", 1, 2)]
    assert {t for _, t in stored["shingle-prefixes"].dtypes} <= {"bigint", "int"}
