"""Rejection rules on hand-written candidates, and the co-listing rule on hand-written sentences."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import rules as RU

C = "p string, a string, r string, b string"


def args():
    return F.col("p"), F.col("a"), F.col("r"), F.col("b")


CASES = [
    ("We saw the honey bee, Apis mellifera here.", "honey bee", "eats", "Apis mellifera", "same_organism"),
    ("We saw Apis mellifera (the honey bee) here.", "Apis mellifera", "eats", "honey bee", "same_organism"),
    ("x", "wolf|Canis lupus", "eats", "canis  lupus", "same_organism"),
    ("Cotesia rubecula (Hymenoptera: Braconidae) was reared.", "Cotesia rubecula", "parasitizes", "Braconidae", "own_clade"),
    ("Apis mellifera Linnaeus, 1758 visits flowers.", "Linnaeus", "visits", "flowers x", "authority"),
    ("A is close to B.", "A", "sister|sister to", "B", "non_biotic_relation"),
    ("It lives on non-wheat hosts.", "wheat", "infects", "rust", "negated"),
    ("We detected no infections with the parasite Leucocytozoon here.", "Leucocytozoon", "infects", "owl", "negated"),
    ("Galls on leaves.", "leaves", "infects", "mite", "not_an_organism"),
    ("equine influenza virus infections in human beings", "equine", "infects", "influenza", "pathogen_modifier"),
    ("equine herpesvirus in equine and human hosts", "equine", "infects", "herpesvirus", None),
    ("The wasp parasitizes the moth.", "wasp", "parasitizes", "moth", None),
    ("without affecting the host it infected wheat", "wheat", "infected", "rust", None),
]


@pytest.mark.parametrize("passage,a,r,b,reason", CASES)
def test_first_reason(spark, passage, a, r, b, reason):
    df = spark.createDataFrame([(passage, a, r, b)], C)
    assert df.select(RU.reject_reason(*args())).first()[0] == reason


def test_subset_of_rules(spark):
    df = spark.createDataFrame([("x leaves", "leaves", "sister", "b")], C)
    assert df.select(RU.reject_reason(*args(), only=["not_an_organism"])).first()[0] == "not_an_organism"


CO_LISTED = [
    ("We ate beetles, ducks and cockroaches.", True),
    ("cockroaches, mites; beetles", True),
    ("BEETLES or Cockroaches", True),
    ("beetles that eat cockroaches", False),
    ("beetles infect many, cockroaches", False),
    ("beetles cockroaches", False),
    ("beetles, " + "x" * 90 + ", cockroaches", False),
    ("beetles," + "x" * 78 + " cockroaches", True),
    ("beetles," + "x" * 79 + " cockroaches", False),
    ("beetles @ and cockroaches", False),
    ("beetlesand, cockroaches", False),
    ("no names", False),
    # the second mention stands in a list, the first does not
    ("beetles are eaten by beetles, ducks and cockroaches.", True),
    # the nearest pair has no connector, a farther one has
    ("cockroaches, cockroaches beetles", True),
    ("beetles cockroaches, cockroaches", True),
    # "beetles" inside the gap begins like the breaking word "be"
    ("beetles, beetles cockroaches", False),
    ("beetles eat mites found on beetles during May; cockroaches", False),
]


def test_co_listed(spark):
    df = spark.createDataFrame([(p, "beetles", "", "cockroaches") for p, _ in CO_LISTED], C)
    got = df.select("p", RU.co_listed(F.col("p"), F.col("a"), F.col("b"))).collect()
    assert {r[0]: r[1] for r in got} == dict(CO_LISTED)
