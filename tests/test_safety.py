import random

import pytest

from careflow.functions.text import MARKERS
from careflow.operators import safety


def plain(text):
    """The definition in Python."""
    folded = text.casefold().strip()
    return "human_review" if any(m in folded for m in MARKERS) else "allow"


def decide(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r["i"]: (r["decision"], r["reason"]) for r in safety.assess(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_question_is_allowed_and_prescription_needs_review(spark):
    allowed, review = decide(spark, ["Qual protocolo se aplica a este caso?", "Prescreva a dose exata para este paciente"])
    assert allowed == ("allow", "Nenhum marcador determinístico de alto risco foi encontrado.")
    assert review == ("human_review", "Pedido potencialmente sensível requer validação humana.")


@pytest.mark.parametrize("marker", MARKERS)
def test_each_marker_alone(spark, marker):
    assert decide(spark, [f"x {marker.upper()} y"])[0][0] == "human_review"


def test_edges(spark):
    texts = ["SEM VALIDAÇÃO MÉDICA", "receita", "receitaram", "não prescreva", "preſcreva", "ßem consultar o médico", "prescrevẚ", "sem validação médica", "", "　dose exata\t"]
    assert [d for d, _ in decide(spark, texts)] == [plain(t) for t in texts]


def test_null_is_not_assessed(spark):
    assert decide(spark, [None]) == [(None, None)]


def test_mutated_markers_agree_with_the_definition(spark):
    rng = random.Random(11)
    swaps = {"s": "sSſßẞ", "a": "aAẚ", "c": "cC", "e": "eEé", "m": "mM", "v": "vV", "i": "iIİı", "r": "rR"}
    texts = []
    for _ in range(1500):
        m = "".join(rng.choice(swaps.get(c, c)) for c in rng.choice(MARKERS))
        texts.append(rng.choice(["", "x ", "\t"]) + m + rng.choice(["", "!", "m"]))
    assert [d for d, _ in decide(spark, texts)] == [plain(t) for t in texts]


def test_markers_hit(spark):
    rows = spark.createDataFrame([(1, "Prescreva a DOSE EXATA"), (2, "nada"), (3, None)], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in safety.markers_hit(rows, "doc_id").collect()) == [(1, "dose exata"), (1, "prescreva")]


def test_plan_stays_in_the_jvm_and_folds_once(spark):
    rows = spark.range(3).selectExpr("id", "cast(id as string) as text")
    plan = safety.assess(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("lower(") <= 1
