"""Hand-off policy: escalation decisions, drafts, error codes, calibration and sweeps, as column expressions."""

from __future__ import annotations

import json
import os
from collections import ChainMap
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.functions import numbers as nu
from colloq.functions import text as tx
from colloq.functions.expressions import let
from colloq.operators.retrieval import payload

# Intents that always go to a person, thresholds, weights and reply phrases.
RISK_INTENTS = ("account_access", "charge_issue", "delivered_but_not_received", "delivered_wrong_location", "refund_request", "cancellation", "product_return_and_replacement", "service_complaint_escalation", "other_unclear")
NO_INTENT = ("none", "other_unclear")
OPENERS = {
    "thank": "Hello! Thank you for taking the time to write to us.",
    "sorry": "Hello! We are sorry to hear about this experience.",
    "default": "Hello! This is {brand} Customer Service.",
}
NEXT_STEP = "To help, please share a little more detail (for example the order number or the exact message you see) and we'll take it from there."
ESCALATION = "Thank you for raising this. I have included our specialists on this thread so they can look into it for you; they will follow up with next steps shortly."


#: Thresholds that a file may state.
STATED = {"p_intent_low", "sim_floor", "comb_low"}


@dataclass(frozen=True)
class Thresholds:
    p_intent_low: float = 0.30  # kept for records; no rule uses it
    sim_floor: float = 0.02
    comb_low: float = 0.45
    w_intent: float = 0.6
    w_sim: float = 0.4
    risk: tuple[str, ...] = RISK_INTENTS

    @classmethod
    def load(cls, path: str | None) -> Thresholds:
        """The defaults, but for what a JSON file states: three numbers by name, in its object "thresholds" or beside it
        (what stands beside it counts more)."""
        stated = ChainMap()
        if path is not None and os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                document = json.load(file)
            stated = ChainMap(document, document.get("thresholds", {}))
        return cls(**{name: stated[name] for name in STATED & set(stated)})


def decide(intent: Column, p: Column, hits: Column, th: Thresholds = Thresholds()) -> Column:
    """struct(action, reason, sim_mean, confidence). ``hits``: array of (score, brand_response), best first.

    The first rule that holds decides: no actionable intent, high-risk intent, no hits, no usable reply
    in the first three, mean similarity below its floor, confidence below its floor.
    """
    head = F.slice(hits, 1, 3)
    sim = nu.mean_of_first(F.transform(hits, lambda h: h["score"]))
    usable = F.exists(head, lambda h: h["brand_response"].isNotNull() & (h["brand_response"] != ""))
    confidence = nu.clamp01(th.w_intent * p + th.w_sim * sim)
    reason = (
        F.when(intent.isin(*NO_INTENT), F.concat(F.lit("intent="), intent, F.lit(" (no actionable intent)")))
        .when(intent.isin(*th.risk), F.concat(F.lit("intent="), intent, F.lit(" (high-risk category)")))
        .when(F.size(hits) == 0, F.lit("no retrieval hits"))
        .when(~usable, F.lit("no usable reply in top-3 evidence"))
        .when(sim < th.sim_floor, F.concat(F.lit("sim_mean="), F.format_string("%.2f", sim), F.lit(f" < {th.sim_floor}")))
        .when(confidence < th.comb_low, F.concat(F.lit("confidence="), F.format_string("%.2f", confidence), F.lit(f" < comb_low={th.comb_low}")))
    )
    return F.struct(
        F.when(reason.isNull(), F.lit("auto_handle")).otherwise(F.lit("escalate")).alias("action"),
        F.coalesce(reason, F.lit("confident intent + evidence present")).alias("reason"),
        sim.alias("sim_mean"),
        confidence.alias("confidence"),
    )


def opener(key: str, brand: str) -> str:
    return " ".join(OPENERS[key].format(brand=brand).split())


def draft_auto(reply: Column, brand: str = "") -> Column:
    """Opener by the reply's cue, the grounded reply, the next step; without a reply opener and next step."""
    there = F.coalesce(reply, F.lit("")) != ""
    opened = let(
        F.when(there, tx.cue(reply)).otherwise(F.lit("default")),
        lambda kind: F.when(kind == "sorry", opener("sorry", brand)).when(kind == "thank", opener("thank", brand)).otherwise(opener("default", brand)),
    )
    body = let(tx.grounded_body(reply), lambda b: F.when(b != "", b))
    return F.when(there, F.concat_ws(" ", opened, body, F.lit(NEXT_STEP))).otherwise(F.concat_ws(" ", opened, F.lit(NEXT_STEP)))


def draft_escalation(brand: str = "") -> Column:
    return F.lit(f"{opener('sorry', brand)} {ESCALATION}")


def build_draft(action: Column, hits: Column, brand: str = "") -> Column:
    reply = tx.first_nonempty(F.transform(hits, lambda h: h["brand_response"]))
    return F.when(action == "escalate", draft_escalation(brand)).otherwise(draft_auto(reply, brand))


def respond(rows: DataFrame, th: Thresholds = Thresholds(), brand: str = "") -> DataFrame:
    """rows(example_id, message, intent, p, hits) with the decision, the draft and evidence counts."""
    d = rows.withColumn("d", decide(F.col("intent"), F.col("p"), F.col("hits"), th))
    return d.select(
        *[c for c in d.columns if c != "d"], "d.action", F.array("d.reason").alias("action_reasons"), F.bround("d.sim_mean", 4).alias("sim_mean"), F.bround("d.confidence", 4).alias("action_confidence"),
        build_draft(F.col("d.action"), F.col("hits"), brand).alias("draft"), F.size("hits").alias("n_evidence"),
        F.size(F.filter("hits", lambda h: F.coalesce(h["brand_response"], F.lit("")) != "")).alias("n_usable"),
    )


def answer(queries: DataFrame, intents: DataFrame, hits: DataFrame, cases: DataFrame, th: Thresholds = Thresholds(), brand: str = "") -> DataFrame:
    """The whole chain for a table of queries (query_id, text): intents(query_id, intent, p), ranked hits(query_id, doc_id,
    score, rank) and the cases(doc_id, brand_response, language) they name make decision, draft and evidence counts.

    A query without an intent has 'none' with probability 0; one without hits has none.
    """
    found = payload(hits, cases, columns=["brand_response", "language"])
    ranked = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "brand_response", "language"))).alias("h"))  # top-k a query
    rows = queries.select("query_id", "text").join(intents, "query_id", "left").join(ranked, "query_id", "left")
    none = F.array().cast("array<struct<score:double,brand_response:string,language:string>>")
    evidence = F.coalesce(F.transform("h", lambda h: F.struct(h["score"].alias("score"), h["brand_response"].alias("brand_response"), h["language"].alias("language"))), none)
    asked = rows.select(F.col("query_id").alias("example_id"), F.col("text").alias("message"), F.coalesce("intent", F.lit("none")).alias("intent"), F.coalesce("p", F.lit(0.0)).alias("p"), evidence.alias("hits"))
    return respond(asked, th, brand).drop("hits")


def calibrate(rows: DataFrame, target_rate: float, th: Thresholds = Thresholds()) -> float:
    """The confidence below which ``target_rate`` of rows fall: sorted[round(rate * (n - 1))], over rows that no earlier rule escalates."""
    from colloq.operators.metrics import order_statistics

    open_ = replace(th, comb_low=-1.0)
    scored = rows.select(decide(F.col("intent"), F.col("p"), F.col("hits"), open_).alias("d")).select(F.col("d.confidence").alias("c"))
    return order_statistics(scored, "c", target_rate).first()["rounded_index"]


def sweep(rows: DataFrame, floors: Sequence[float], th: Thresholds = Thresholds()) -> DataFrame:
    """(floor, n, n_escalated, rate) under the full rules for each confidence floor, in one pass."""
    open_ = replace(th, comb_low=-1.0)
    d = rows.select(decide(F.col("intent"), F.col("p"), F.col("hits"), open_).alias("d")).select(F.col("d.action") == "escalate", "d.confidence").toDF("before", "confidence")
    each = d.select("before", "confidence", F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor"))
    out = F.col("before") | (F.col("confidence") < F.col("floor"))
    return each.groupBy("floor").agg(F.count("*").alias("n"), F.count_if(out).alias("n_escalated"), F.avg(out.cast("double")).alias("rate"))


def error_codes(rows: DataFrame) -> Column:
    """The codes that apply to an answered row (true_intent, intent, secondary_intents, action, intent_prob, hits, draft, language)."""
    hits = F.col("hits")
    sim = nu.mean_of_first(F.transform(hits, lambda h: h["score"]))
    replies = F.filter(F.transform(hits, lambda h: h["brand_response"]), lambda r: r.isNotNull())
    usable = F.exists(replies, lambda r: r != "")
    wrong = ~F.col("intent").eqNullSafe(F.col("true_intent"))
    close = F.coalesce(F.array_contains("secondary_intents", F.col("intent")), F.lit(False))
    auto = F.col("action") == "auto_handle"
    first_language = F.get(F.transform(hits, lambda h: h["language"]), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(wrong & close, F.lit("intent_close_secondary")),
            F.when(wrong & ~close & (F.col("intent") == "none"), F.lit("intent_predicted_none")),
            F.when(wrong & ~close & (F.col("intent") != "none"), F.lit("intent_off_target")),
            F.when(~auto & (F.col("intent_prob") >= 0.30) & usable & (sim >= 0.12), F.lit("escalation_conservative")),
            F.when(auto & (~usable | (sim < 0.12)), F.lit("escalation_false_auto")),
            F.when(auto & ~F.exists(replies, lambda r: tx.shares_words(F.col("draft"), r)), F.lit("drafting_ungrounded")),
            F.when((F.col("language") != first_language) & (F.col("language") != "en") & (first_language != ""), F.lit("retrieval_lang_mismatch")),
        )
    )
