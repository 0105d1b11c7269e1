"""Pieces of check SQL (DuckDB)."""

from __future__ import annotations

from rewardloom.functions.text import SPACE as S
from rewardloom.functions.text import WHITESPACE
from suite.fixtures import QUESTIONS_SQL, ROLLOUTS_SQL

WS = "'" + WHITESPACE + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def questions(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([f"q AS ({QUESTIONS_SQL})", *ctes]) + " " + body


def rollouts(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([f"r AS ({ROLLOUTS_SQL})", *ctes]) + " " + body


def last_tagged(x: str, tag: str) -> str:
    return strip(f"split_part(split_part({x}, '<{tag}>', -1), '</{tag}>', 1)")


def first_tagged(x: str, tag: str) -> str:
    return strip(f"split_part(split_part({x}, '<{tag}>', 2), '</{tag}>', 1)")


def pair(x: str, tag: str) -> str:
    return f"(contains({x}, '<{tag}>') AND contains({x}, '</{tag}>'))"


# What rewards read from a response.
PARSED = f"""p0 AS (
  SELECT *, response AS c, ground_truth AS g, lower(response) AS low,
         {last_tagged('response', 'answer')} AS cased,
         {first_tagged('response', 'confidence')} AS raw,
         {pair('response', 'answer')} AS ha, {pair('response', 'confidence')} AS hc
  FROM r), p AS (
  SELECT *, {last_tagged('low', 'answer')} AS ans, {last_tagged('low', 'reasoning')} AS reas,
         CASE WHEN upper(substr(cased, 1, 1)) IN ('A', 'B', 'C') THEN upper(substr(cased, 1, 1))
              ELSE cased END AS lettered,
         CASE WHEN hc AND regexp_matches(raw, '^[0-9]{{1,3}}$') AND TRY_CAST(raw AS INT) <= 100
              THEN CAST(TRY_CAST(raw AS INT) AS DOUBLE) / 100.0 END AS conf,
         lower({strip('g')}) AS truth
  FROM p0)"""

# The same, with the outcome spelled out for the confidence rewards.
JUDGED = """j AS (
  SELECT *, ans = truth AS ok, upper(ans) = 'C' AS neu, upper(truth) = 'C' AS gneu,
         conf * 100.0 AS pct, CASE WHEN ans = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o
  FROM p)"""

# What the evaluation reads from a response.
_BARE = strip("response")
EVALUATED = f"""e0 AS (
  SELECT *, {pair('response', 'answer')} AS ha, {pair('response', 'confidence')} AS hc,
         {_BARE} AS bare,
         TRY_CAST(nullif(regexp_extract({first_tagged('response', 'confidence')},
                                        '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS number,
         greatest(logit_a, logit_b, logit_c) AS top,
         logit_a IS NULL OR logit_b IS NULL OR logit_c IS NULL AS nologit
  FROM r), e1 AS (
  SELECT *, CASE WHEN ha THEN {first_tagged('response', 'answer')} ELSE bare END AS predicted_answer,
         ha OR (bare <> '' AND length(bare) <= 200) AS parsed_successfully,
         CASE WHEN ha AND hc THEN CASE WHEN number > 1 THEN number / 100 ELSE number END END
           AS confidence_score,
         exp(logit_a - top) AS wa, exp(logit_b - top) AS wb, exp(logit_c - top) AS wc
  FROM e0), e AS (
  SELECT *, coalesce(parsed_successfully AND
                     lower({strip('predicted_answer')}) = lower({strip('ground_truth')}), false)
           AS is_correct,
         CASE WHEN contains(response, '<answer>') THEN
           CASE WHEN nologit THEN 0.333 ELSE wa / (wa + wb + wc) END END AS answer_prob_A,
         CASE WHEN contains(response, '<answer>') THEN
           CASE WHEN nologit THEN 0.333 ELSE wb / (wa + wb + wc) END END AS answer_prob_B,
         CASE WHEN contains(response, '<answer>') THEN
           CASE WHEN nologit THEN 0.333 ELSE wc / (wa + wb + wc) END END AS answer_prob_C,
         response IS NULL OR (parsed_successfully AND ground_truth IS NULL) AS is_error
  FROM e1)"""

# What the few-shot evaluation reads from a reply.
REPLIED = f"""f0 AS (
  SELECT *, {strip('reply')} AS text,
         regexp_extract({strip('reply')}, '^([^{S[1:-1]}]+)', 1) AS predicted_answer,
         greatest(logit_a, logit_b, logit_c) AS top,
         logit_a IS NULL OR logit_b IS NULL OR logit_c IS NULL AS nologit
  FROM r), f1 AS (
  SELECT *, exp(logit_a - top) AS wa, exp(logit_b - top) AS wb, exp(logit_c - top) AS wc FROM f0
), f AS (
  SELECT *, upper(predicted_answer) IN ('A', 'B', 'C') AS parsed_successfully,
         coalesce(upper(predicted_answer) = upper({strip('ground_truth')}), false) AS is_correct,
         CASE WHEN nologit THEN 0.333 ELSE wa / (wa + wb + wc) END AS answer_prob_A,
         CASE WHEN nologit THEN 0.333 ELSE wb / (wa + wb + wc) END AS answer_prob_B,
         CASE WHEN nologit THEN 0.333 ELSE wc / (wa + wb + wc) END AS answer_prob_C,
         reply IS NULL OR ground_truth IS NULL AS is_error
  FROM f1)"""
