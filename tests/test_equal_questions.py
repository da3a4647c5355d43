"""Full-text lookup of many equal queries."""

from pageloom.operators import answers


def test_equal_queries_are_asked_once(spark, monkeypatch):
    texts = [(i, "rotes Haus", f"steht hier {i}") for i in range(20)]
    asked = [(i, ("rote Häuser", "Haus, rot", "das Haus")[i % 3]) for i in range(30)] + [(99, "rotes Haus fehlt")]
    stored = {}
    write = answers.materialised

    def counted(df, name, *rest):
        stored[name] = write(df, name, *rest)
        return stored[name]

    monkeypatch.setattr(answers, "materialised", counted)
    got = answers.qa_fulltext(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(texts, "answer_id long, question string, answer string")).collect()
    assert sorted((r.query_id, r.answer_id) for r in got) == [(i, 0) for i in range(30)]
    assert len({r["rank"] for r in got}) == 2
    assert stored["full-hits"].count() == 20  # one pair of stems with twenty answers, not twenty such queries
