"""Checks that a report cites only evidence that was supplied, and its canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pyrewatch.functions.text import stripped
from pyrewatch.schemas import INSUFFICIENT, RESULT

_IDS = "array<string>"


def _ids(column: Column) -> Column:
    return F.transform(F.coalesce(column, F.array().cast(_IDS)), stripped)


def _concluded() -> Column:
    return F.col("root_cause.cause") != INSUFFICIENT


def _cited() -> Column:
    """Every cited id of a report with the place that cites it, as one array."""
    def entries(place: Column, ids: Column) -> Column:
        return F.transform(ids, lambda e, i: F.struct(place.alias("place"), i.cast("int").alias("position"), e.alias("evidence_id")))

    def both(h: Column) -> Column:
        return F.concat(_ids(h["supporting_evidence_ids"]), _ids(h["contradicting_evidence_ids"]))

    def listed(name: str) -> Column:
        items = F.transform(F.coalesce(F.col(name), F.array().cast(RESULT[name].dataType)), lambda x: stripped(x["evidence_id"]))
        return entries(F.lit(name), items)

    alternatives = F.flatten(F.transform("alternative_causes", lambda h, i: entries(
        F.concat(F.lit("alternative_causes["), i.cast("string"), F.lit("]")), both(h))))
    actions = F.flatten(F.transform("recommended_actions", lambda a: entries(
        F.lit("recommended_actions"), _ids(a["evidence_ids"]))))
    return F.concat(
        entries(F.lit("root_cause"), both(F.col("root_cause"))), alternatives, actions, listed("supporting_evidence"),
        listed("contradicting_evidence"), listed("timeline"))


def citations(results: DataFrame) -> DataFrame:
    """Every cited id with the place that cites it: (incident_id, place, position, evidence_id)."""
    return results.select("incident_id", F.explode(_cited()).alias("c")).select("incident_id", "c.*")


def unknown_citations(cited: DataFrame, pack: DataFrame) -> DataFrame:
    """Citations of ids the incident's pack does not hold."""
    return cited.join(pack.select("incident_id", "evidence_id"), ["incident_id", "evidence_id"], "left_anti")


def result_violations(results: DataFrame) -> DataFrame:
    """Schema rules of a report: (incident_id, violation)."""
    def blank(c: Column) -> Column:
        return F.coalesce(F.length(c), F.lit(0)) == 0

    def unsound(h: Column) -> Column:
        return blank(h["cause"]) | blank(h["rationale"]) | ~F.coalesce(h["confidence"].between(0, 1), F.lit(False))

    def blank_ids(ids: Column) -> Column:
        return F.exists(_ids(ids), lambda e: e == "")

    root = F.col("root_cause")
    rules = {
        "summary is empty": blank(F.col("summary")),
        "root cause is incomplete or its score is outside 0..1": unsound(root),
        "score is outside 0..1": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "score differs from the root cause's": F.abs(F.col("confidence") - root["confidence"]) > 1e-6,
        "stated cause has no support": _concluded() & (F.size(_ids(root["supporting_evidence_ids"])) == 0),
        "alternative is incomplete or its score is outside 0..1": F.exists("alternative_causes", unsound),
        "blank evidence id": blank_ids(root["supporting_evidence_ids"]) | blank_ids(root["contradicting_evidence_ids"]),
        "action is incomplete": F.exists("recommended_actions", lambda a: blank(a["action"]) | blank(a["rationale"])),
    }
    return _violations(results, rules)


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.select("incident_id", F.explode(_broken(rules)).alias("violation"))


def grounding_violations(results: DataFrame, pack: DataFrame, incidents: DataFrame) -> DataFrame:
    """Reports that are not grounded: unknown incident, unknown ids, uncited claims, unretrieved prior incidents.

    A report's needs are exploded once, each with the kind of row that would meet it, and one anti join against all
    rows that were supplied leaves the violations. A claim without evidence is met by nothing.
    """
    def need(kind: str, key: Column, violation: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), violation.alias("violation"))

    claims = _broken({
        "alternative without support": _concluded() & F.exists("alternative_causes", lambda h: (
            h["cause"] != INSUFFICIENT) & (F.size(_ids(h["supporting_evidence_ids"])) == 0)),
        "action without evidence": _concluded() & F.exists(
            "recommended_actions", lambda a: F.size(_ids(a["evidence_ids"])) == 0),
    })
    similar = F.coalesce(F.col("similar_incidents.incident_id"), F.array().cast(_IDS))
    needs = F.concat(
        F.array(need("incident", F.col("incident_id"), F.lit("unknown incident"))),
        F.array_distinct(F.transform(_cited(), lambda c: need(
            "pack", c["evidence_id"], F.concat(c["place"], F.lit(" cites "), c["evidence_id"])))),
        F.transform(similar, lambda s: need("history", s, F.concat(F.lit("similar incident "), s, F.lit(" was not retrieved")))),
        F.transform(claims, lambda v: need("claim", F.lit(""), v)))
    wanted = results.select("incident_id", F.explode(needs).alias("n")).select("incident_id", "n.*")
    history = F.col("source_type") == "HISTORICAL_INCIDENT"
    kinds = F.when(history, F.array(F.lit("pack"), F.lit("history"))).otherwise(F.array(F.lit("pack")))
    supplied = pack.select("incident_id", F.explode(kinds).alias("kind"), F.col("evidence_id").alias("key")).unionByName(
        incidents.select("incident_id", F.lit("incident").alias("kind"), F.col("incident_id").alias("key")))
    return wanted.join(supplied, ["incident_id", "kind", "key"], "left_anti").select("incident_id", "violation")


def cited_lists(results: DataFrame) -> DataFrame:
    """Unique supporting and contradicting ids, the root cause's first, then the alternatives', in order."""
    def gathered(name: str) -> Column:
        others = F.flatten(F.transform("alternative_causes", lambda h: _ids(h[name])))
        return F.array_distinct(F.concat(_ids(F.col("root_cause")[name]), others))

    return results.select("incident_id", gathered("supporting_evidence_ids").alias("supporting"),
                          gathered("contradicting_evidence_ids").alias("contradicting"))


def canonical_references(results: DataFrame, pack: DataFrame) -> DataFrame:
    """References and timeline entries with text and time taken from the pack, never from the report."""
    supplied = pack.select("incident_id", "evidence_id", "source_type", "short_description", "timestamp")

    def entries(role: str) -> Column:
        return F.transform(F.col(role), lambda e, i: F.struct(
            F.lit(role).alias("role"), i.cast("int").alias("position"), e.alias("evidence_id")))

    # One read for both lists.
    cited = cited_lists(results).select("incident_id", F.explode(F.concat(entries("supporting"), entries("contradicting"))).alias("r"))
    times = results.select("incident_id", F.lit("timeline").alias("role"), F.posexplode("timeline.evidence_id").alias("position", "evidence_id"))
    wanted = cited.select("incident_id", "r.*").unionByName(times.withColumn("evidence_id", stripped(F.col("evidence_id"))))
    return wanted.join(supplied, ["incident_id", "evidence_id"], "left")


def insufficient_results(incidents: DataFrame, pack: DataFrame, reason: str) -> DataFrame:
    """A valid empty report for every incident without evidence."""
    empty = incidents.select("incident_id").join(pack.select("incident_id"), "incident_id", "left_anti")
    none = F.array().cast(_IDS)
    cause = F.struct(F.lit(INSUFFICIENT).alias("cause"), F.lit(0.0).alias("confidence"), none.alias("supporting_evidence_ids"),
                     none.alias("contradicting_evidence_ids"), F.lit(reason).alias("rationale"))
    action = F.struct(F.lit("Gather further logs and metrics first.").alias("action"), F.lit(reason).alias("rationale"),
                      none.alias("evidence_ids"))
    given = {"incident_id": F.col("incident_id"), "summary": F.lit(reason), "root_cause": cause, "confidence": F.lit(0.0),
             "recommended_actions": F.array(action)}
    return empty.select(*[given.get(f.name, F.array()).cast(f.dataType).alias(f.name) for f in RESULT.fields])


def review_counts(results: DataFrame) -> DataFrame:
    """What a reviewer sees first: the cause and the sizes of the lists."""
    cited = F.concat("supporting_evidence", "contradicting_evidence")
    return results.select(
        "incident_id", F.when(_concluded(), F.col("root_cause.cause")).otherwise("Insufficient evidence").alias("cause"),
        F.size("supporting_evidence").alias("supporting"), F.size("contradicting_evidence").alias("contradicting"),
        F.size("alternative_causes").alias("alternatives"), F.size("similar_incidents").alias("historical"),
        F.size(F.filter(cited, lambda r: r["source_type"] == "TECHNICAL_DOCUMENT")).alias("technical"),
        F.size("recommended_actions").alias("actions"))


def evidence_cards(references: DataFrame) -> DataFrame:
    """One card per cited id: its first supporting mention, or a contradicting one when it supports nothing."""
    roles = references.where(F.col("role").isin("supporting", "contradicting"))
    order = Window.partitionBy("incident_id", "evidence_id").orderBy(F.desc("role"), "position")
    return roles.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "position")
