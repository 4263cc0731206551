"""Optional model adapters: entity models, verification, sentence encoders.  All are off unless given a function.

A model is any Python callable; it is loaded once a task, sees batches, and a
failing batch gives a status instead of a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilspark.functions.spans import SPANS, bound
from veilspark.functions.tables import ACCEPT_SCORE, ENTITY_TYPES, NAMED_TYPES, NER_SCORE
from veilspark.operators.detect import chunk_bounds

LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "ORGANIZATION": "ORG", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION", "ADDRESS": "ADDRESS"}
REPLY = "decisions array<struct<id:string,keep:boolean,label:string,certainty:string>>, additions array<struct<text:string,label:string,start:int,end:int,certainty:string>>"


def entities(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], threshold: float = NER_SCORE, strategy: str = "mask") -> DataFrame:
    """Adds ``model_spans`` and ``model_status``.  ``load`` gives a function from chunks to lists of label, score, start, end."""
    @F.pandas_udf(f"struct<spans:{SPANS},status:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        try:
            model = load()
        except Exception:
            return pd.DataFrame({"spans": [[] for _ in texts], "status": ["degraded"] * len(texts)})
        rows, states = [], []
        for text in texts:
            text, out = text or "", []
            bounds = chunk_bounds(text, 420, 40)
            try:
                answers = model([text[a:b] for a, b in bounds])
            except Exception:
                rows.append([])
                states.append("degraded")
                continue
            for (base, _), found in zip(bounds, answers, strict=True):
                for e in found:
                    kind, a, b = LABELS.get(str(e["label"]).upper().removeprefix("B-").removeprefix("I-")), base + e["start"], base + e["end"]
                    if kind and e["score"] >= threshold and text[a:b].strip():
                        out.append({"start": a, "end": b, "text": text[a:b], "entity_type": kind, "score": float(e["score"]), "sources": ["NER"], "status": "accepted" if e["score"] >= ACCEPT_SCORE else "pending", "conflict": False, "strategy": strategy, "rule_id": None, "rule_name": None})
            rows.append(out)
            states.append("ok")
        return pd.DataFrame({"spans": rows, "status": states})

    # A model is asked once a row: what is not deterministic stays in a projection of its own.
    return docs.withColumn("x", run.asNondeterministic()(F.col("text"))).select(*docs.columns, F.col("x.spans").alias("model_spans"), F.col("x.status").alias("model_status"))


def verified(text: Column, spans: Column, reply: Column, strategy: str = "mask") -> Column:
    """Spans after a model's JSON reply: decisions by span number, then additions that fit the text.

    A decision's id is ``span_<n>`` by position; unknown ids and labels are ignored.
    """
    return bound(F.struct(spans.alias("spans"), F.from_json(reply, REPLY).alias("reply")), lambda b: _decided(text, b["spans"], b["reply"], strategy))


def _decided(text: Column, spans: Column, parsed: Column, strategy: str) -> Column:
    decision = lambda i: F.get(F.filter(F.coalesce(parsed["decisions"], F.array().cast("array<struct<id:string,keep:boolean,label:string,certainty:string>>")), lambda d: d["id"] == F.concat(F.lit("span_"), i.cast("string"))), F.lit(0))

    def apply(s: Column, i: Column) -> Column:
        d = decision(i)
        changed = s.withField("sources", F.array_sort(F.array_union(s["sources"], F.array(F.lit("LLM"))))).withField("status", F.when(d["keep"], "accepted").otherwise("rejected"))
        return F.when(d.isNull(), s).otherwise(changed.withField("entity_type", F.when(d["label"].isin(*ENTITY_TYPES), d["label"]).otherwise(s["entity_type"])))

    decided = F.transform(spans, apply)
    fits = lambda a: a["label"].isin(*ENTITY_TYPES) & (a["end"] > a["start"]) & (F.substring(text, a["start"] + 1, a["end"] - a["start"]) == a["text"]) & ~F.exists(spans, lambda s: (s["start"] == a["start"]) & (s["end"] == a["end"]))
    sure = lambda a: a["certainty"] == "high"
    added = F.transform(
        F.filter(F.coalesce(parsed["additions"], F.array().cast("array<struct<text:string,label:string,start:int,end:int,certainty:string>>")), fits),
        lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["text"].alias("text"), a["label"].alias("entity_type"), F.when(sure(a), 0.82).otherwise(0.70).alias("score"), F.array(F.lit("LLM")).alias("sources"), F.when(sure(a), "accepted").otherwise("pending").alias("status"), F.lit(False).alias("conflict"), F.lit(strategy).alias("strategy"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("rule_name")),
    )
    return F.concat(decided, added.cast(SPANS))


def doubtful(spans: Column) -> Column:
    """What a model is asked about: open or contested spans, with the ids that its decisions name."""
    numbered = F.transform(spans, lambda s, i: F.struct(F.concat(F.lit("span_"), i.cast("string")).alias("id"), s["text"].alias("text"), s["entity_type"].alias("label"), s["score"].alias("score"), s["sources"].alias("sources"), ((s["status"] == "pending") | s["conflict"]).alias("open")))
    return F.transform(F.filter(numbered, lambda s: s["open"]), lambda s: s.dropFields("open"))


def _checked(reply: str, text: str) -> str | None:
    """What is wrong with a model's reply; None where it can be used."""
    try:
        found = json.loads(reply)
        for d in found.get("decisions") or []:
            if not isinstance(d["id"], str) or not isinstance(d["keep"], bool) or d.get("label", ENTITY_TYPES[0]) not in ENTITY_TYPES:
                return "decision"
        for a in found.get("additions") or []:
            if a["label"] not in ENTITY_TYPES or not 0 <= a["start"] < a["end"] <= len(text) or text[a["start"] : a["end"]] != a["text"]:
                return "addition"
    except (ValueError, KeyError, TypeError, AttributeError):
        return "form"
    return None


def replies(docs: DataFrame, load: Callable[[], Callable[[dict], str]], attempts: int = 2, spans: str = "spans", instruction: str | None = None) -> DataFrame:
    """Adds ``reply`` and ``reply_status`` (ok, degraded, or skipped where no span is open).

    ``load`` gives a function from a request (context, candidates, what was wrong before) to a JSON reply.  A reply that
    does not fit its text is asked for again; a row without a usable one keeps its spans.
    """
    import pyarrow as pa

    from veilspark.operators.detect import routed

    columns = docs.columns

    def one(load_once, text: str, context: str, candidates: str) -> tuple[str | None, str]:
        wrong, reply = None, None
        for _ in range(attempts):
            try:
                reply = load_once()({"context": context, "candidates": json.loads(candidates), "instruction": instruction, "wrong": wrong})
                wrong = _checked(reply, text)
            except Exception as error:  # a model that fails must not fail the job
                wrong = type(error).__name__
            if wrong is None:
                return reply, "ok"
        return None, "degraded"

    def run(batches):
        model = []

        def load_once():
            if not model:
                model.append(load())
            return model[0]

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "asked_context", "asked_spans")), strict=True)
            said = [one(load_once, text or "", context, candidates) for text, context, candidates in rows]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r for r, _ in said], pa.string()), pa.array([s for _, s in said], pa.string())], [*columns, "reply", "reply_status"])

    asked = docs.withColumns({"asked_context": routed("text"), "asked_spans": F.to_json(doubtful(F.col(spans)))})
    return asked.mapInArrow(run, StructType([*docs.schema.fields, StructField("reply", StringType()), StructField("reply_status", StringType())]))


def cosines(terms: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], pools: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds ``scores`` to ``text, entity_type``: the cosine of a sentence encoder with each candidate of the type's pool, in [0, 1].

    Null where the encoder fails or the type has no pool; the draw then goes by the features (``anonymize.weights``).
    """
    import numpy as np

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        try:
            encode = load()
            unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            table = {k: unit(np.asarray(encode(list(p)), float)) for k, p in pools.items()}
            own = unit(np.asarray(encode(texts.fillna("").tolist()), float)) if len(texts) else None
        except Exception:  # without an encoder the features decide
            return pd.Series([None] * len(texts), dtype=object)
        return pd.Series([np.clip(table[k] @ v, 0, 1).tolist() if k in table else None for v, k in zip(own if own is not None else [], kinds, strict=True)], dtype=object)

    return terms.withColumn("scores", run("text", "entity_type"))


def levels_from(terms: DataFrame, providers: list[tuple[str, Callable[[str], str]]], ttl_seconds: int = 86_400) -> DataFrame:
    """Rows for the cache of :func:`knowledge.enrich` from ``term, entity_type``: providers are asked in order, the first
    usable answer counts; where none answers, the local levels do and ``status`` is degraded."""
    from veilspark.operators.knowledge import remote_levels

    names = [n for n, _ in providers]

    @F.pandas_udf("array<string>")
    def ask(asked: pd.Series) -> pd.Series:
        def one(term: str) -> list[str | None]:
            out = []
            for _, provider in providers:
                try:
                    out.append(provider(term))
                except Exception:  # the next provider is asked
                    out.append(None)
            return out

        return asked.map(one)

    wanted = terms.where(F.col("entity_type").isin(*NAMED_TYPES)).select("term", "entity_type").distinct()
    answers = wanted.select("term", "entity_type", F.posexplode(ask("term")).alias("at", "body"))
    found = remote_levels(answers.withColumn("which", F.col("at")), keep=("which",))
    best = found.groupBy("term", "entity_type").agg(F.min_by(F.struct("levels", "source", "which"), F.struct((F.col("source") != "remote").cast("int"), "which")).alias("x"))
    remote = F.col("x.source") == "remote"
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("x.which"))
    return best.select("term", "entity_type", F.col("x.levels").alias("levels"), F.col("x.source").alias("source"), F.when(remote, name).otherwise("local").alias("provider"), F.when(remote, "ready").otherwise("degraded").alias("status"), (F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
