"""Stems of German words, and ranks by the distances of a query's words."""

import math

from pyspark.sql import functions as F

from pageloom.functions.stems import stem
from pageloom.operators import answers

# Words and their stems in the published vocabulary of the rules.
STEMS = """aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgender aufeinanderfolg aufeinanderschlügen aufeinanderschlug auferstehung aufersteh auferlegt auferlegt
aufenthalts aufenthalt kategorie kategori kategorien kategori kater kat katers kat katze katz käuflich kauflich kaufleute kaufleut kätzchen katzch kauerte kauert kaum kaum kaute kaut
häuser haus ergebnisse ergebnis freundlichkeit freundlich straße strass bauer bau bauen bau frauen frau""".split()


def test_stems_of_stated_words(spark):
    df = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2], strict=True)) + [("", ""), ("e", "e"), (None, None)], "word string, want string")
    assert [tuple(r) for r in df.select("word", "want", stem(F.col("word")).alias("got")).where("not (want <=> got)").collect()] == []


def test_ranks_by_distance(spark):
    texts = [
        (1, "Rote Häuser", "am Meer"), (2, "Häuser", "in der Stadt, rot und alt"), (3, "rotes Haus", "rote Häuser"), (4, "Haus", None), (5, None, None),
        (6, "rot", "x " * 150 + "Haus"), (7, "Meer", "Meer Meer"),
    ]
    asked = [(10, "rotes haus"), (11, "Häuser der Stadt"), (12, "Meere"), (13, "der die das"), (14, None), (15, "Berg"), (16, "stadt Stadt rote"), (17, "rotes haus")]
    got = answers.qa_fulltext(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(texts, "answer_id long, question string, answer string"))
    c = lambda d: 0.1 / math.sqrt(1.005 + 0.05 * math.exp(d / 1.5 - 2))
    near = 1 - (1 - c(1)) ** 3 * (1 - c(3))  # answer 3: places 0 and 2 of one word, 1 and 3 of the other
    want = {10: (3, near), 17: (3, near), 11: (2, c(3)), 12: (7, 0.1 * (1 + 1 / 4 + 1 / 9) / 1.64493406685), 16: (2, c(1))}
    assert {r.query_id: (r.answer_id, r.rank) for r in got.collect()} == {k: (a, round(x, 6)) for k, (a, x) in want.items()}
