"""Known answers on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions import maths as M
from claimweave.functions import mentions as MN
from claimweave.functions import names as N
from claimweave.functions import relations as R
from claimweave.functions import text as T
from claimweave.operators import graph as G
from claimweave.operators import trust as TR
from claimweave.plans.aggregates import contradiction_index, resolve_notices, with_risk
from claimweave.plans.scalar import parse_list_cell


def one(spark, value, schema, *cols):
    return spark.createDataFrame([value], schema).select(*cols).first()


@pytest.mark.parametrize(
    "text,kind,score",
    [
        ("Ticks were collected from the field in June.", "field_observation", 1.0),
        ("The strain was grown in vitro for a week.", "lab_experiment", 0.55),
        ("It has long been known that mites bite.", "meta_analysis", 0.40),
        ("Mites bite.", "unknown", 0.30),
        ("Twelve rats were later infected with the worm.", "in_vivo_experiment", 0.75),
    ],
)
def test_evidence(spark, text, kind, score):
    k = E.evidence_type(F.col("t"))
    assert tuple(one(spark, (text,), "t string", k, E.evidence_score(k))) == (kind, score)


def test_publication_type_wins_over_wording(spark):
    types = F.array(F.lit("Journal Article"), F.lit("Systematic Review"))
    assert one(spark, ("collected from the field",), "t string", E.evidence_type("t", types))[0] == "meta_analysis"


@pytest.mark.parametrize(
    "text,negated",
    [
        ("The mite does not infect the bee.", True),
        ("There was no evidence of infection.", True),
        ("It failed to infect the host.", True),
        ("The tick transmits the spirochaete.", False),
    ],
)
def test_negation(spark, text, negated):
    flag, match = one(spark, (text,), "t string", E.is_negated("t"), E.negation_match("t"))
    assert flag is negated and (match is not None) is negated


def test_lexicon_scores(spark):
    rows = [
        ("the wasp parasitizes the moth and eats pollen.",),
        ("the wasp does not infect the moth.",),
        ("nothing happens here.",),
        ("we used a protocol in table 2: it preys on moths.",),
        ("the wasp infects, parasitizes and preys on moths but not beetles.",),
    ]
    got = E.with_lexicon(spark.createDataFrame(rows, "text string"), "text").select("lex_strength", "lex_signal").collect()
    assert [tuple(r) for r in got] == [(0.7, True), (0.0, False), (0.0, False), (0.15, True), (0.35, True)]


def test_decay(spark):
    y = lambda v: one(spark, (v,), "y int", M.temporal_score("y"))[0]
    assert y(2024) > 0.88 and y(1990) < 0.5 and y(1960) < 0.15 and y(None) == 0.4


def test_contradiction(spark):
    rows = [("c1", "A a b.", 1, "A a", "B b", "eats"), ("c2", "A a eats B b.", 1, "A a", "B b", "eats"), ("c3", "x", 0, "A a", "B b", "eats")]
    c = spark.createDataFrame(rows, "claim_id string, text string, label int, source_species string, target_species string, interaction_type string")
    ix = contradiction_index(c).first()
    assert (ix["n_pos"], ix["n_neg"]) == (2, 1) and 0 < ix["base"] < 0.5
    assert all(0 < r["risk"] <= 0.5 and r["conflict"] for r in with_risk(c).collect())


def test_notices(spark):
    rows = [(1, 1, "correction"), (1, 2, "retraction"), (1, 3, "retraction"), (2, 1, "retraction"), (2, 2, "reinstatement"), (2, 3, "retraction"), (3, 1, "other")]
    got = {r["paper_id"]: (r["nature"], r["seq"]) for r in resolve_notices(spark.createDataFrame(rows, "paper_id int, seq int, nature string")).collect()}
    assert got == {1: ("retraction", 2), 2: ("reinstatement", 2), 3: ("other", 1)}


def test_unknown_pair(spark):
    """A pair the index does not hold: 0.1 when the sentence is negated, else 0; never a conflict."""
    from claimweave.plans.aggregates import contradiction_index

    schema = "claim_id string, text string, label int, source_species string, target_species string, interaction_type string"
    known = spark.createDataFrame([("c", "A eats B.", 1, "A", "B", "eats")], schema)
    asked = spark.createDataFrame([("q1", "C does not eat D.", 1, "C", "D", "eats"), ("q2", "C eats D.", 1, "C", "D", "eats")], schema)
    got = {r.claim_id: (r.risk, r.conflict) for r in with_risk(asked, contradiction_index(known)).collect()}
    assert got == {"q1": (0.1, False), "q2": (0.0, False)}


def test_document_without_years(spark):
    docs = spark.createDataFrame([(1, None, False, False), (2, 2020, True, False)], "doc_id int, year int, retracted boolean, corrected boolean")
    refs = spark.createDataFrame([(1, "d", None, False), (2, "d", 2000, False)], "doc_id int, ref_doi string, ref_year int, ref_retracted boolean")
    got = {r.doc_id: r for r in TR.document_trust(docs, refs).collect()}
    # 0.35 + 0.15 * 0.4 + 0.30 + 0.20 * 0.5
    assert got[1].median_age is None and got[1].overall == 0.81 and got[1].grade == "B"
    assert got[2].overall == 0.15 and got[2].grade == "F"


def test_retraction_scores(spark):
    papers = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "paper int")
    notices = spark.createDataFrame([(1, "retraction"), (2, "correction"), (3, "reinstatement")], "paper_id int, nature string")
    got = {r["paper"]: (r["retraction_score"], r["retracted"]) for r in TR.notice_scores(papers, notices, "paper", F.col("paper") == 4).collect()}
    assert got == {1: (0.0, True), 2: (0.6, False), 3: (0.85, False), 4: (1.0, False), None: (0.85, False)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", y) for y in (2001, 1999, 2010, 2005)] + [("b", 1990)], "k string, y int")
    assert {r["k"]: r["m"] for r in TR.upper_median(df, ["k"], "y", "m").collect()} == {"a": 2005, "b": 1990}


@pytest.mark.parametrize(
    "name,norm",
    [
        ("Quercus robur L.", "quercus robur"),
        ("Bellis perennis (L.) 1753", "bellis perennis"),
        ("Ficus elastica var decora", "ficus elastica decora"),
        ("Viscum album (L.) van Tieghem, 1894", "viscum album"),
        ("Élodéa canadensis", "elodea canadensis"),
    ],
)
def test_name_normaliser(spark, name, norm):
    got = one(spark, (name,), "n string", N.normalize_name("n"), N.normalize_name("n", N.PEEL_PASSES + 1))
    assert tuple(got) == (norm, norm)


def test_name_variants(spark):
    got = one(spark, ("Canis lupus familiaris",), "n string", N.name_variants("n"))[0]
    assert set(got) == {"Canis lupus familiaris", "Canis lupus", "C. lupus", "Canis", "C. lupus familiaris"}


def test_species_counts(spark):
    c = lambda t: one(spark, (t,), "t string", N.count_species("t"))[0]
    assert c("Apis mellifera pollinates Malus domestica.") == 2
    assert c("The bee was seen.") == 0
    assert c("leishmania infantum was isolated") >= 1


def test_identifiers(spark):
    pm = lambda t: one(spark, (t,), "t string", N.pmid_of("t"))[0]
    assert pm("https://pubmed.ncbi.nlm.nih.gov/12345678/") == "12345678"
    assert pm("https://www.ncbi.nlm.nih.gov/pubmed/12345678") == "12345678"
    assert pm("7654321") == "7654321" and pm("http://x.org/1") is None
    assert one(spark, ("see doi:10.1234/Ab.9.",), "t string", N.doi_of("t"))[0] == "10.1234/ab.9"


@pytest.mark.parametrize("rel,pol", [("parasite of", 1), ("eaten by", -1), ("interacts with", 0), ("infects", 1), ("host of", -1), ("zzz", None)])
def test_polarity(spark, rel, pol):
    assert one(spark, (rel,), "r string", R.polarity("r")[0])[0] == pol


def test_polarity_index(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,), (None,)], "p int")
    two = [r[0] for r in df.select(R.polarity_index(F.col("p"), 2)).collect()]
    three = [r[0] for r in df.select(R.polarity_index(F.col("p"), 3)).collect()]
    assert two == [1, 0, 0, 0] and three == [1, 0, 2, 0]


def test_categories(spark):
    c = lambda t: one(spark, (t,), "t string", R.category_by_rule("t"))[0]
    assert [c(x) for x in ("endoparasite of", "parasitoid of", "preys on", "pollinates", "has vector", "near")] == [
        "ENDOPARASITISM", "PARASITOIDISM", "PREDATION", "POLLINATION", "VECTOR", "GENERIC",
    ]


TERMS = "term string, predicate string, directed boolean, ro_id string"
RAW = "id int, name_1 string, type_1 string, kingdom_1 string, name_2 string, type_2 string, kingdom_2 string, interaction_type string"


def infer(spark, *row):
    terms = spark.createDataFrame([("pollinates", "pollinates", True, "RO_1"), ("preys on", "preys on", True, "RO_2")], TERMS)
    return G.infer_relations(spark.createDataFrame([(1, *row)], RAW), terms).first()


def test_typed_edges(spark):
    e = infer(spark, "V", "PATHOGEN", None, "H", "HOST", None, "infects")
    assert (e.subject, e.predicate, e.object, e.directed, e.ro_id) == ("V", "infects", "H", True, "RO_0002556")
    e = infer(spark, "H", "HOST", None, "T", "VECTOR", None, "x")
    assert (e.subject, e.predicate, e.object) == ("T", "transmits_to", "H")
    e = infer(spark, "Plant", "ORGANISM", "Plantae", "Bee", "ORGANISM", "Animalia", "pollinates")
    assert (e.subject, e.object) == ("Bee", "Plant")
    e = infer(spark, "A", "ORGANISM", None, "B", "ORGANISM", None, "symbioticWith")
    assert (e.directed, e.flag) == (False, "ambiguous")
    e = infer(spark, "A", "ORGANISM", None, "B", "ORGANISM", None, "unheard")
    assert (e.directed, e.flag) == (False, "unvalidated")


def test_hypergeometric_surprise(spark):
    # P(X >= 2), N = 10, K = 4, n = 3: (C(4,2)·C(6,1) + C(4,3)) / C(10,3) = 40 / 120
    got = one(spark, (2, 4, 3, 10), "k int, d int, n int, p int", M.hypergeom_surprise(F.col("k"), F.col("d"), F.col("n"), F.col("p")))[0]
    assert got == pytest.approx(-math.log10(1 / 3), abs=1e-9)


def test_log_gamma(spark):
    for n in (1, 2, 7, 50, 1000):
        assert one(spark, (n,), "n int", M.log_gamma(F.col("n")))[0] == pytest.approx(math.lgamma(n), abs=1e-8)


def test_sentences_keep_abbreviations(spark):
    text = "We saw mites, cf. Fig. 2 of Dr. Smith et al. Then it rained. Was it cold? Yes, very cold."
    got = one(spark, (text,), "t string", T.split_sentences(F.col("t")))[0]
    assert got == ["We saw mites, cf. Fig. 2 of Dr. Smith et al. Then it rained.", "Was it cold?", "Yes, very cold."]


def test_sentence_quality(spark):
    ok = lambda t: one(spark, (t,), "t string", T.good_sentence("t"))[0]
    assert ok("The small wasp lays its eggs in the larvae of the moth.")
    assert not ok("Too short.") and not ok("Table 3 shows the number of wasps found in each of the nine plots.")
    assert not ok("1234567 (12345) [123456] 1234567 1234567 1234567 abc def ghi jkl mno pqr stu vwx yz abcd")


def test_locate(spark):
    loc = lambda n, t: one(spark, (n, t), "n string, t string", MN.locate("n", "t"))[0]
    assert tuple(loc("African buffalo|Syncerus caffer", "We saw Syncerus caffer.")) == ("Syncerus caffer", 8)
    assert tuple(loc("Aedes aegypti", "Many Aedes here.")) == ("Aedes", 6)
    assert loc("Aedes aegypti", "Aedeomyia only.") is None


def test_mention_offsets(spark):
    text = "Here Apis mellifera met Malus cf. domestica."
    got = one(spark, (text,), "t string", MN.binomial_mentions("t"))[0]
    assert [(m.start, m.mention, m.qualified) for m in got] == [(5, "Apis mellifera", False), (24, "Malus cf. domestica", True)]
    assert all(text[m.start :].startswith(m.mention) for m in got)


def test_list_cells(spark):
    p = lambda c: one(spark, (c,), "c string", parse_list_cell("c"))[0]
    assert p('["a", " b "]') == ["a", "b"] and p("a, b,,") == ["a", "b"] and p("nan") == [] and p(None) == []


def test_claims_are_judged_once(spark):
    """A claim that carries its polarity needs no text: neither the index nor the risk judges it again."""
    c = spark.createDataFrame([("c1", 1, "A b", "C d", "preysOn", False), ("c2", 1, "A b", "C d", "preysOn", True)], "claim_id string, label int, source_species string, target_species string, interaction_type string, negated boolean")
    got = {r.claim_id: (r.n_pos, r.n_neg, r.risk) for r in with_risk(c).collect()}
    assert got == {"c1": (1, 1, 0.5), "c2": (1, 1, 0.8)}
