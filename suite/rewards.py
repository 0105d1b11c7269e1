"""A query and check SQL for every reward."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.functions.language import FUNCTION_WORDS
from rewardloom.operators.scoring import score
from suite import fixtures, sql
from suite.sql import S

OPTIONS = {"options": ["A", "B", "C"], "values": [1.0, 0.0, 0.5]}
DIMS = ["the", "une", "nicht", "pero"]

# The arguments each reward is run with here.
ARGS = {
    "right_answer_in_completion": {},
    "answer_in_completion": {"options": ["A", "B", "C", "no"]},
    "answer_distance": OPTIONS,
    "xml_format": {},
    "soft_format": {},
    "hard_format": {"min_group_lengths": [200, 1], "max_group_lengths": [5000, 3]},
    "multistep_format": {},
    "multistep_xml_format": {"num_thoughts": 2},
    "modular_step_format": {
        "step_names": ["step1", "step2", "step3"],
        "min_step_lengths": [200, 5, 3],
        "max_step_lengths": [-1, 100, 2000],
    },
    "three_step_format": {},
    "two_stage_format": {"min_think_lengths": [300]},
    "language": {"language": "de"},
    "length": {"optimal_length": 400},
    "profile_used_reward": {"profile_dims": DIMS},
    "entailment": {},
    "confidence_aware_answer": {},
    "brier_calibration": {"sharpness_weight": 0.2},
    "loglikelihood_calibration": {},
    "focal_confidence": {},
    "high_confidence_accuracy": {},
    "low_confidence_humility": {},
    "neutral_when_uncertain": {},
    "high_confidence_neutral_penalty": {},
    "confidence_provision": {},
    "neutral_ground_truth": {},
    "simple_confidence": {},
}
SPECS = [{"name": name, "args": args} for name, args in ARGS.items()]
COLUMNS = {"completion": "response", "answers": "ground_truth"}


def run(name: str):
    def query(spark, sf_dir):
        rollouts = fixtures.with_class_scores(fixtures.rollouts(spark, sf_dir))
        scores = score(
            rollouts,
            [{"name": name, "args": ARGS[name]}],
            keep=["sample_id", "repeat_id"],
            **COLUMNS,
        )
        return scores.withColumn(name, F.round(name, 6))

    return query


def _once(token: str, worth: float) -> str:
    count = f"(length(c) - length(replace(c, '{token}', ''))) / {len(token)}"
    return f"CASE WHEN {count} = 1 THEN {worth}::DOUBLE ELSE 0 END"


def _outside(token: str, part: int) -> str:
    return f"(length(split_part(c, '{token}', {part})) - 1) * 0.001::DOUBLE"


def _blocks(*tags: str) -> str:
    return f"{S}*".join(f"<{tag}>(.*?)</{tag}>" for tag in tags)


def _group(pattern: str, i: int) -> str:
    return f"regexp_extract(c, '{pattern}', {i}, 's')"


def _scored(value: str) -> str:
    return f"CASE WHEN NOT (ha AND hc) THEN 0 WHEN conf IS NULL THEN -1 ELSE {value} END"


def _words(code: str) -> str:
    words = ", ".join(f"'{word}'" for word in FUNCTION_WORDS[code])
    return f"len(list_intersect(tokens, [{words}]))"


def _language(wanted: str) -> str:
    n = {code: _words(code) for code in sorted(FUNCTION_WORDS)}
    votes = f"greatest({', '.join(n.values())})"
    cases = " ".join(f"WHEN {n[code]} = {votes} THEN '{code}'" for code in n)
    return (
        f"CASE WHEN (CASE WHEN {votes} = 0 THEN 'en' {cases} END) = '{wanted}' "
        "THEN 1.0 ELSE 0.0 END"
    )


HARD = _blocks("reasoning", "answer")
STEPS = _blocks("step1", "step2", "step3", "answer")
STAGES = _blocks("think", "confidence", "think", "answer")
# Fixed value: what the repeated-block format is.
THOUGHTS = f"((<thought>(.*?)</thought>{S}*)+){S}*<answer>(.*?)</answer>"

# The phrases that show the profile was used.
PHRASES = [
    "based on the user''s preferences",
    "based on the user''s past",
    "based on the user''s profile",
    "based on the user''s history",
    "based on the user''s data",
    "from the user''s preferences",
    "from the user''s past",
    "from the user''s profile",
    "from the user''s history",
    "from the user''s data",
    "using the user''s preferences",
    "using the user''s past",
    "using the user''s profile",
    "using the user''s history",
    "using the user''s data",
    "the user''s preferences",
    "the user''s past",
    "the user''s profile",
    "the user''s history",
    "the user''s data",
    "user''s preferences",
    "user''s past",
    "user''s profile",
    "user''s history",
    "user''s data",
    "according to the user''s preferences",
    "according to the user''s past",
    "according to the user''s profile",
    "according to the user''s history",
    "according to the user''s data",
]


def _lengths(pattern: str, groups: int) -> list[str]:
    return [f"length({sql.strip(_group(pattern, i + 1))})" for i in range(groups)]


def _modular(least: list[int], most: list[int]) -> str:
    *steps, answer = _lengths(STEPS, 4)
    checks = [f"{answer} >= 1"] + [f"{s} >= {n}" for s, n in zip(steps, least)]
    checks += [f"{s} <= {n}" for s, n in zip(steps, most) if n > 0]
    return (
        f"CASE WHEN NOT regexp_matches(c, '{STEPS}', 's') THEN 0 "
        f"WHEN {' AND '.join(checks)} THEN 1 ELSE 0.3 END"
    )


def _any(text: str, phrases: list[str]) -> str:
    return " OR ".join(f"contains({text}, '{phrase}')" for phrase in phrases)


_AREA = "substr({}, 1, 5)"
_NO_RATHER = sql.strip("replace(ans, 'rather', '')")
_NO_WORDS = sql.strip(f"replace(replace({_NO_RATHER}, 'yes', ''), 'no', '')")
_START = sql.strip(_AREA.format(_NO_RATHER))
_VALUE = "CASE lower(g) WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.0 WHEN 'c' THEN 0.5 END"
_LABEL = "CASE WHEN g IN ('A', 'B') THEN 'LABEL_1' ELSE 'LABEL_0' END"
_UNSURE = "ok AND gneu AND neu AND conf * 100.0 < 50"
_CLAMPED = "greatest(0.00000001::DOUBLE, least((1 - 0.00000001)::DOUBLE, conf))"

# Reward expressions over the parsed rollouts.
EXPRESSIONS = {
    "right_answer_in_completion": f"CASE WHEN length({_NO_WORDS}) = 0 THEN -0.5 "
    f"WHEN contains({_AREA.format(_NO_WORDS)}, lower(g)) THEN 1.0 ELSE 0.0 END",
    "answer_in_completion": f"CASE WHEN ha AND {_NO_RATHER} IN ('a', 'b', 'c', 'no') "
    "THEN 0.5 ELSE 0.0 END",
    "answer_distance": f"CASE WHEN contains({_START}, 'a') THEN 2.0 - 2.0 * abs(1.0 - {_VALUE}) "
    f"WHEN contains({_START}, 'b') THEN 2.0 - 2.0 * abs(0.0 - {_VALUE}) "
    f"WHEN contains({_START}, 'c') THEN 2.0 - 2.0 * abs(0.5 - {_VALUE}) ELSE 0.0 END",
    "xml_format": f"CASE WHEN answer_only THEN {_once('<answer>', 0.5)} + "
    f"{_once('</answer>', 0.5)} - {_outside('<answer>', 1)} - {_outside('</answer>', -1)} "
    f"ELSE {' + '.join(_once(t, 0.125) for t in ('<reasoning>', '</reasoning>', '<answer>', '</answer>'))}"
    f" - {_outside('<reasoning>', 1)} - {_outside('</answer>', -1)} - "
    "CASE WHEN strpos(c, '</reasoning>') > 0 AND strpos(c, '<answer>') > strpos(c, '</reasoning>') "
    "THEN (strpos(c, '<answer>') - strpos(c, '</reasoning>') - 12) * 0.001::DOUBLE ELSE 0 END END",
    "soft_format": f"CASE WHEN regexp_matches(c, '^{HARD}') THEN 0.5 ELSE 0.0 END",
    "hard_format": f"CASE WHEN NOT regexp_matches(c, '{HARD}', 's') THEN 0 "
    f"WHEN length({_group(HARD, 1)}) BETWEEN 200 AND 5000 AND length({_group(HARD, 2)}) BETWEEN 1 AND 3 "
    "THEN 1 ELSE 0.5 END",
    "multistep_format": f"CASE WHEN regexp_matches(c, '{THOUGHTS}', 's') THEN 1.0 ELSE 0.0 END",
    "multistep_xml_format": "CASE WHEN n_open <= 2 THEN 0.1::DOUBLE * n_open ELSE 0.5 - 0.1::DOUBLE * n_open END + "
    "CASE WHEN n_close <= 2 THEN n_close ELSE 0.5 - 0.1::DOUBLE * n_close END + "
    "CASE WHEN contains(c, '<answer>') THEN 0.5 ELSE 0 END + "
    "CASE WHEN contains(c, '</answer>') THEN 0.5 ELSE 0 END - "
    "coalesce(list_sum(list_transform(pieces[1:n_open], "
    "lambda x: 1 - 0.001::DOUBLE * length(split_part(x, '</thought>', -1)))), 0)",
    "modular_step_format": _modular([200, 5, 3], [-1, 100, 2000]),
    "three_step_format": _modular([10, 10, 10], [-1, -1, -1]),
    "two_stage_format": f"CASE WHEN NOT regexp_matches(c, '{STAGES}', 's') THEN 0 WHEN "
    f"{_lengths(STAGES, 4)[0]} >= 300 AND {_lengths(STAGES, 4)[2]} >= 10 "
    f"AND {_lengths(STAGES, 4)[3]} >= 1 "
    f"AND regexp_matches({sql.strip(_group(STAGES, 2))}, '^[0-9]{{1,3}}$') "
    f"AND TRY_CAST({sql.strip(_group(STAGES, 2))} AS INT) BETWEEN 0 AND 100 THEN 1 ELSE 0.3 END",
    "language": _language("de"),
    "length": "CASE WHEN answer_only THEN 0 ELSE -abs(400 - length(c)) * 0.001::DOUBLE END",
    "profile_used_reward": f"CASE WHEN {_any('reas', DIMS)} THEN 1.0 ELSE 0.0 END + "
    f"CASE WHEN {_any('reas', PHRASES)} THEN 0.5 ELSE 0.0 END",
    "entailment": f"CASE k % 4 WHEN 1 THEN NULL WHEN 0 THEN s ELSE "
    f"CASE WHEN {_LABEL} = 'LABEL_1' THEN s ELSE 1.0 - s END END * 2.0",
    "confidence_aware_answer": "CASE WHEN NOT ha THEN 0 "
    "WHEN conf IS NULL THEN CASE WHEN ok THEN 0.9 ELSE 0.1 END "
    "WHEN pct >= 70 THEN CASE WHEN neu AND NOT ok THEN -0.3 WHEN ok THEN 1.0 ELSE -0.5 END "
    "WHEN ok THEN 0.5 WHEN neu AND pct < 50 THEN 0.4 ELSE 0.2 END",
    "brier_calibration": _scored(
        f"0.5 * o + 0.5 * (CASE WHEN {_UNSURE} THEN 0 ELSE -pow(conf - o, 2) END) "
        "+ 0.2::DOUBLE * abs(conf - 0.5)"
    ),
    "loglikelihood_calibration": _scored(
        f"0.5 * o + 0.5 * (CASE WHEN {_UNSURE} THEN 0 "
        f"ELSE o * ln({_CLAMPED}) + (1 - o) * ln(1 - {_CLAMPED}) END)"
    ),
    "focal_confidence": _scored(
        f"CASE WHEN {_UNSURE} THEN 0 ELSE -(abs(conf - 0.5) + 0.1::DOUBLE) * pow(conf - o, 2) END"
    ),
    "high_confidence_accuracy": _scored(
        "CASE WHEN pct >= 70 THEN CASE WHEN neu THEN CASE WHEN ok THEN 1.0 ELSE 0.0 END "
        "WHEN ok THEN 1.0 ELSE -0.5 END ELSE 0 END"
    ),
    "low_confidence_humility": _scored(
        "CASE WHEN pct < 70 THEN CASE WHEN pct < 50 AND neu AND NOT ok THEN 0.0 "
        "WHEN ok THEN 0.5 ELSE 0.2 END ELSE 0 END"
    ),
    "neutral_when_uncertain": _scored("CASE WHEN pct < 50 AND neu AND NOT ok THEN 0.4 ELSE 0 END"),
    "high_confidence_neutral_penalty": _scored(
        "CASE WHEN pct >= 70 AND neu AND NOT ok THEN -0.3 ELSE 0 END"
    ),
    "confidence_provision": "CASE WHEN NOT ha THEN 0 WHEN conf IS NULL THEN "
    "CASE WHEN ok THEN -0.05 ELSE -0.1 END ELSE 0 END",
    "neutral_ground_truth": _scored("CASE WHEN gneu AND neu AND pct < 50 THEN 0.5 ELSE 0 END"),
    "simple_confidence": "CASE WHEN NOT ha OR upper(lettered) = 'C' THEN 0 "
    "WHEN conf IS NULL THEN -0.1 WHEN lower(lettered) = truth THEN conf ELSE -conf END",
}

# Rewards that are NULL without a true answer.
NEEDS_TRUTH = {"right_answer_in_completion", "answer_distance", "entailment"} | set(
    list(ARGS)[list(ARGS).index("confidence_aware_answer") :]
)

EXTRA = """x AS (
  SELECT *, regexp_split_to_array(low, '[^\\p{L}]+') AS tokens, string_split(c, '<thought>') AS pieces, len(string_split(c, '<thought>')) - 1 AS n_open,
         len(string_split(c, '</thought>')) - 1 AS n_close, sample_id * 8 + repeat_id AS k,
         CAST((sample_id * 8 + repeat_id) % 100 AS DOUBLE) / 100.0 AS s
  FROM j)"""


def reward_sql(name: str) -> str:
    """The reward as an expression over the CTE ``x``, rounded as the query is.

    Adding zero turns a negative zero into a plain one.
    """
    missing = "c IS NULL OR g IS NULL" if name in NEEDS_TRUTH else "c IS NULL"
    return (
        f"CASE WHEN {missing} THEN NULL ELSE "
        f"round(CAST({EXPRESSIONS[name]} AS DOUBLE), 6) + 0.0::DOUBLE END AS {name}"
    )


CTES = (sql.PARSED, sql.JUDGED, EXTRA)

QUERIES = {f"reward_{name}": run(name) for name in ARGS}
ORACLES = {
    f"reward_{name}": sql.rollouts(f"SELECT sample_id, repeat_id, {reward_sql(name)} FROM x", *CTES)
    for name in ARGS
}
