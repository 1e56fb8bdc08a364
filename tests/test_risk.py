import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import risk, verdicts
from riskloom.plans import scoring
from riskloom.session import build_session

GOOD = '{"risk_score": 0.85, "indicators": ["a", " b "], "recommendations": ["c"], "confidence": "High"}'


def read(frame, *raws):
    rows = frame(list(enumerate(raws)), "i int, raw string")
    return [r.verdict for r in scoring.read_verdicts(rows).orderBy("i").collect()]


def test_good_answers(frame):
    for raw in (GOOD, f"```json\n{GOOD}\n```", f"```\n{GOOD}```\n", f"  ```json {GOOD} ```  "):
        (got,) = read(frame, raw)
        assert got.error is None and got.risk_score == 0.85 and got.confidence == "High"
        assert got.indicators == ["a", "b"] and got.recommendations == ["c"]


def test_scores_lists_and_defaults(frame):
    got = read(
        frame, '{"risk_score": "0.4"}', "{\"confidence\": \"High\"}", '{"risk_score": 1, "indicators": ["", null, "  x  "]}',
        '{"risk_score": 0.2, "recommendations": []}',
    )
    assert [g.risk_score for g in got] == [0.4, 0.0, 1.0, 0.2]
    assert all(g.error is None for g in got)
    assert got[0].confidence == "Low" and got[1].confidence == "High"
    assert got[2].indicators == ["x"] and got[3].recommendations == []


@pytest.mark.parametrize("raw", [None, "no JSON", "", "{}", "[]", "null", "```json\n{}\n```", '{"risk_score": 0.4'])
def test_unavailable(frame, raw):
    (got,) = read(frame, raw)
    assert got.error == verdicts.UNAVAILABLE and got.risk_score == 0.0
    assert got.recommendations == [verdicts.FALLBACK_ADVICE] and got.indicators == [] and got.confidence == "Low"


@pytest.mark.parametrize(
    "raw", ['{"risk_score": "high"}', '{"risk_score": null}', "[1]", "3", '{"risk_score": 0.4, "indicators": null}',
            '{"risk_score": 0.4, "indicators": 5}']
)
def test_failed(frame, raw):
    (got,) = read(frame, raw)
    assert got.error == verdicts.FAILED and got.risk_score == 0.0


def test_backslashes(frame):
    legal, broken = '{"risk_score": 0.4, "indicators": ["a\\nb"]}', '{"risk_score": 0.4, "indicators": ["a\\$b"]}'
    got = read(frame, legal, broken)
    assert got[0].indicators == ["a\nb"] and got[1].indicators == ["a\\$b"]


def test_prompt(frame):
    rows = frame([(0, "hi", ""), (1, "pay", "financial: x")], "i int, text string, summary string")
    got = [r.prompt for r in verdicts.build_prompts(rows).orderBy("i").collect()]
    assert got[0].startswith("Analyze the potential fraud risk of the following text:\n\nText: hi\n\nDetected patterns:\nNo ")
    assert "Detected patterns:\nfinancial: x\n\nPlease provide" in got[1] and got[1].endswith('"Low/Medium/High"\n}')


def test_levels_at_their_bounds(spark):
    scores = [0.0, 0.2999, 0.3, 0.4999, 0.5, 0.6999, 0.7, 1.0]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").coalesce(1)
    got = [r.level for r in rows.select(risk.risk_level(F.col("s")).alias("level")).collect()]
    assert got == ["Low Risk"] * 2 + ["Medium Risk"] * 2 + ["High Risk"] * 2 + ["Critical Risk"] * 2


def test_blend(spark):
    row = spark.range(1).select(
        risk.blended(F.lit(0.5), F.lit(0.5), F.lit(1.0)).alias("full"),
        risk.blended(F.lit(0.4333), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("pattern"),
        risk.blended(F.lit(1.0), F.lit(0.0), F.lit(0.0), {"pattern": 1.0, "similarity": 0.0, "verdict": 0.0}).alias("own"),
    ).head()
    assert tuple(row) == (0.65, 0.1733, 1.0)


def test_score_messages(frame):
    messages = frame(
        [(1, "URGENT: verify your bank account"), (2, "ok"), (3, None), (4, "lunch at noon"), (5, "  hi ")],
        "msg_id bigint, text string",
    )
    cases = frame([(1, [("known scam text", 0.45), ("another", 0.2)]), (2, [("x", 0.5)])],
                  "msg_id bigint, similar_cases array<struct<text:string,similarity:double>>")
    answers = scoring.read_verdicts(frame([(1, GOOD), (2, GOOD), (4, "bad")], "msg_id bigint, raw string"))
    got = {r.msg_id: r for r in scoring.score_messages(messages, cases, answers).collect()}
    assert len(got) == 5
    top = got[1]
    assert top.total_score == 0.4333 and top.max_similarity == 0.45
    assert top.risk_score == round(0.4333 * 0.4 + 0.45 * 0.3 + 0.85 * 0.3, 4) and top.risk_level == "High Risk"
    assert top.report == (
        "**Risk Level**: Medium Risk\n\n**Suspicious Patterns**  \n- Mentions of banks, amounts, accounts, etc."
        "  \n- Urges immediate action or response within a limited time"
        "  \n- Contains suspicious words like 'click', 'secure', etc."
        "\n\n**Similar Cases**  \n- Similarity 45.0%: known scam text..."
        "\n\n**Risk Indicators**  \n- a  \n- b\n\n**Recommended Actions**  \n- c"
    )
    for short in (2, 3, 5):
        assert got[short].risk_level == "Invalid Input" and got[short].report == "Text too short"
        assert got[short].risk_score == 0.0 and got[short].similar_cases == [] and got[short].patterns == []
        assert got[short].verdict.error == "Text too short"
    assert got[4].risk_level == "Low Risk" and got[4].verdict.error == verdicts.UNAVAILABLE
    assert got[4].report == "**Risk Level**: Low Risk"


def test_records(frame):
    messages = frame([(1, " pay $5 \\ now "), (2, "   "), (3, "ok")], "msg_id bigint, text string")
    answers = scoring.read_verdicts(frame([(1, GOOD)], "msg_id bigint, raw string"))
    done = scoring.score_requests(messages, answers=answers)
    rows = {r.msg_id: r for r in risk.detection_records(done).collect()}
    assert set(rows) == {1, 3}
    one = rows[1]
    assert one.input_text == "pay $5 \\ now" and one.risk_detected and one.risk_level == "Critical Risk"
    assert one.confidence == 0.85 and one.pattern_analysis.matched_patterns == [r"\$\d[\d,]*"]
    assert one.llm_analysis.indicators == ["a", "b"] and len(one.analysis_id) == 36
    again = risk.detection_records(done).where("msg_id = 1").head()
    assert again.analysis_id == one.analysis_id
    assert rows[3].risk_level == "Low Risk" and rows[3].report == "Text too short"
    assert json.loads(risk.detection_records(done).where("msg_id = 1").toJSON().first())["risk_score"] == 0.85


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_text_only_cases(frame, limit):
    """Texts in, similar texts out, by map and by join: the hashed vectors find the copy of a known case."""
    messages = frame([(1, "claim your prize money now"), (2, "meeting moved to friday"), (3, None)],
                     "msg_id bigint, text string")
    known = frame([(7, "claim your prize money now"), (8, "unrelated words entirely"), (9, None)],
                  "case_id bigint, text string")
    out = scoring.with_cases_from_texts(messages, known, k=2, broadcast_bytes=limit)
    got = {r.msg_id: r.similar_cases for r in out.collect()}
    assert [c.text for c in got[1]] == ["claim your prize money now", "unrelated words entirely"]
    assert got[1][0].similarity == 0.5 and got[1][1].similarity == 0.25
    assert got[2][0].similarity < 0.5 and len(got[3]) == 2
    assert out.columns == ["msg_id", "text", "similar_cases"]
    scored = {r.msg_id: r for r in scoring.score_messages(out).collect()}
    assert scored[1].max_similarity == 0.5 and scored[3].similar_cases == []


def test_scoring_is_a_map_when_the_row_holds_everything(frame):
    messages = frame([(1, "claim your prize money now", GOOD)], "msg_id bigint, text string, raw string")
    known = frame([(7, "claim your prize money now")], "case_id bigint, text string")
    done = scoring.score_messages(scoring.with_cases_from_texts(scoring.read_verdicts(messages), known))
    source = messages._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") == source
    assert done.head().risk_score == round(0.1333 * 0.4 + 0.5 * 0.3 + 0.85 * 0.3, 4)


def test_no_known_cases(frame):
    messages = frame([(1, "hello there")], "msg_id bigint, text string")
    none = frame([], "case_id bigint, text string")
    assert scoring.with_cases_from_texts(messages, none).head().similar_cases == []


def test_session_is_reused(spark):
    assert build_session().sparkContext is spark.sparkContext
