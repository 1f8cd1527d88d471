"""Catalogues of tags, requirements from manifests, and repairs of targets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontree as J


def catalog_issues(tags: DataFrame) -> DataFrame:
    """(issue, detail) of an approved catalogue: a repeated code, a missing label or description, a label of two codes, several provenances."""
    twice = tags.groupBy("category", "code").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_code").alias("issue"), F.col("code").alias("detail"))
    blank = tags.where("coalesce(trim(label), '') = '' OR coalesce(trim(description), '') = ''").select(F.lit("incomplete"), "code")
    shared = tags.groupBy("category", "label").agg(F.count_distinct("code").alias("n")).where("n > 1 AND label != ''").select(F.lit("shared_label"), "label")
    origins = tags.agg(F.count_distinct("provenance").alias("n")).where("n > 1").select(F.lit("several_provenances"), F.col("n").cast("string"))
    return twice.union(blank).union(shared).union(origins)


def descriptions(tags: DataFrame) -> DataFrame:
    """(code, description); an error for a code without a translation."""
    checked = F.when(F.coalesce(F.trim("description"), F.lit("")) == "", F.raise_error(F.concat(F.lit("no description of "), "code"))).otherwise(F.col("description"))
    return tags.select("code", checked.alias("description"))


def tag_variants(nodes: DataFrame) -> DataFrame:
    """(code, labels, titles): how often each label and tooltip of a tag occurs, as ordered lists of (text, n)."""
    t = nodes.where("map_contains_key(data, 'code')").select(F.col("data")["code"].alias("code"), F.col("data")["label"].alias("label"), F.col("data")["title"].alias("title"))

    def of(c: str) -> DataFrame:
        return t.where(F.col(c).isNotNull()).groupBy("code", c).agg(F.count("*").alias("n")).groupBy("code").agg(F.sort_array(F.collect_list(F.struct(F.col(c).alias("text"), "n"))).alias(f"{c}s"))

    return of("label").join(of("title"), "code", "full_outer")


def unification(before: DataFrame, after: DataFrame) -> DataFrame:
    """(code, labels_before, labels_after, unified) of the node tables of two archives: unified where one label is left."""
    a = tag_variants(before).select("code", F.size("labels").alias("labels_before"))
    b = tag_variants(after).select("code", F.size("labels").alias("labels_after"))
    return a.join(b, "code", "full_outer").withColumn("unified", F.coalesce(F.col("labels_after") == 1, F.lit(False)))


def uncanonical(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags in trees whose label isn't the one of their code; none after localisation."""
    t = nodes.where("map_contains_key(data, 'code')").select("pointer", F.col("data")["code"].alias("code"), F.col("data")["label"].alias("label"))
    return t.join(mapping.select("code", F.col("label").alias("wanted")), "code", "left").where("NOT (label <=> wanted)")


def bank_issues(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(label, issue) of localised bank rows read through the inverse map: unknown or repeated labels, and labels that are missing."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    j = n.join(mapping.select("label").distinct().withColumn("__m", F.lit(True)), "label", "full_outer")
    issue = F.when(F.col("__m").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return j.select("label", issue.alias("issue")).where("issue IS NOT NULL")


_MANIFEST = "articles array<struct<units array<struct<unit_id string, source_sha256 string, required struct<source string, target string>>>>>"


def requirements(manifests: DataFrame, body: str) -> DataFrame:
    """(unit_id, source, target) that stored manifests ask for; an error where they disagree."""
    u = manifests.select(F.explode(F.from_json(body, _MANIFEST, {"mode": "FAILFAST"})["articles"]).alias("a")).select(F.explode("a.units").alias("u")).where("u.required IS NOT NULL")
    g = u.groupBy("u.unit_id").agg(F.count_distinct("u.required.target").alias("n"), F.max("u.required.source").alias("source"), F.max("u.required.target").alias("target"))
    return g.select("unit_id", "source", F.when(F.col("n") == 1, F.col("target")).otherwise(F.raise_error(F.concat(F.lit("two targets for "), "unit_id"))).alias("target"))


def required_payload(manifests: DataFrame, body: str) -> DataFrame:
    """Adds ``payload``: (unit_id, target) of all units if every one has a required target, else null."""
    units = F.flatten(F.col("__m.articles.units"))
    return (
        manifests.withColumn("__m", F.from_json(body, _MANIFEST))
        .withColumn("payload", F.when(F.forall(units, lambda u: u["required"].isNotNull()), F.transform(units, lambda u: F.struct(u["unit_id"].alias("unit_id"), u["required"]["target"].alias("target")))))
        .drop("__m")
    )


def resolutions_applied(decisions: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Decisions with hand-made choices (note, sequence) in place; an error for a choice that isn't a candidate."""
    c = choices.join(candidates.select("note", "sequence").distinct().withColumn("__ok", F.lit(True)), ["note", "sequence"], "left")
    c = c.select("note", F.when(F.col("__ok"), F.col("sequence")).otherwise(F.raise_error(F.lit("a choice isn't a candidate"))).alias("chosen"))
    j = decisions.join(c, "note", "left")
    return j.select("note", F.when(F.col("chosen").isNotNull(), "included").otherwise(F.col("decision")).alias("decision"), F.coalesce("chosen", "sequence").alias("sequence"))


def run_blockers(decisions: DataFrame) -> DataFrame:
    """Notes that keep a run from being made: unresolved ones and those decided more than once."""
    g = decisions.groupBy("note").agg(F.count_if(F.col("decision") == "included").alias("n"), F.count_if(F.col("decision") == "excluded").alias("x"))
    return g.where("n != 1 AND NOT (n = 0 AND x = 1)")


def remediation(findings: DataFrame) -> DataFrame:
    """(unit, target, tokens): replacements grouped by unit and put in, longest token first; units with a token that has no replacement are left out."""
    g = findings.groupBy("unit", "text").agg(F.collect_set(F.struct((-F.length("token")).alias("k"), "token", "replacement")).alias("r")).where("forall(r, x -> x.replacement IS NOT NULL)")
    target = F.aggregate(F.sort_array("r"), F.col("text"), lambda acc, x: F.replace(acc, x["token"], x["replacement"]))
    return g.select("unit", target.alias("target"), F.sort_array(F.col("r.token")).alias("tokens"))


def localised_templates(text: Column, templates: dict[str, str]) -> Column:
    """A text that begins with a fixed phrase, with the phrase in the other language; other texts as they are."""
    out = text
    for old, new in sorted(templates.items(), key=lambda x: len(x[0])):
        out = F.when(text.startswith(old), F.concat(F.lit(new), F.substring(text, F.lit(len(old) + 1), F.length(text)))).otherwise(out)
    return out


def ingested(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Batches after their responses: only one that bears the lease token of its claim counts, and only while the batch is leased."""
    ok = responses.select("batch", F.col("token").alias("__t"), "valid").dropDuplicates(["batch", "__t"])
    j = batches.join(ok, (batches["batch"] == ok["batch"]) & (batches["token"] == ok["__t"]), "left").select(batches["*"], "valid")
    new = F.when((F.col("state") == "leased") & F.col("valid"), "validated").when((F.col("state") == "leased") & ~F.col("valid"), "queued").otherwise(F.col("state"))
    return j.select(*[new.alias("state") if c == "state" else F.when(new == "leased", F.col("token")).alias("token") if c == "token" else F.col(c) for c in batches.columns])


_ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "markdownDescription", "deprecated", "readOnly", "writeOnly"}
_CHECKED = {
    *("$ref", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "type", "enum", "const", "required", "properties", "patternProperties", "additionalProperties", "propertyNames"),
    *("minProperties", "maxProperties", "items", "prefixItems", "additionalItems", "contains", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "format"),
    *("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"),
}
_FORMATS = {
    "date-time": r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)",
    "date": r"\d{4}-\d\d-\d\d",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:\S+",
    "email": r"[^@\s]+@[^@\s]+",
    "uuid": r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "regex": r"(?s).*",
}


def _plain(value):
    """A value to be compared as JSON does: 1 is 1.0 but not true."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return (type(value).__name__, value)
    if isinstance(value, list):
        return ("list", tuple(map(_plain, value)))
    if isinstance(value, dict):
        return ("dict", frozenset((k, _plain(v)) for k, v in value.items()))
    return ("number", value)


def schema_issues(value, schema, at: str = "", root=None) -> list[str]:
    """What breaks a JSON schema. References are those within the schema; a keyword or format that isn't known is an error."""
    import re

    root = schema if root is None else root
    here = at or "/"
    if isinstance(schema, bool):
        return [] if schema else [f"{here}: not allowed"]
    if unknown := sorted(set(schema) - _CHECKED - _ANNOTATIONS):
        raise ValueError(f"keywords that aren't checked: {unknown}")
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
    out = []

    def sub(v, rule, where=at):
        return schema_issues(v, rule, where, root)

    if "$ref" in schema:
        if not schema["$ref"].startswith("#"):
            raise ValueError(f"a reference to elsewhere: {schema['$ref']}")
        rule = root
        for step in filter(None, schema["$ref"][1:].split("/")):
            rule = rule[int(step)] if isinstance(rule, list) else rule[step.replace("~1", "/").replace("~0", "~")]
        out += sub(value, rule)
    wanted = schema.get("type")
    if wanted is not None:
        wanted = wanted if isinstance(wanted, list) else [wanted]
        whole = isinstance(value, float) and value.is_integer() and "integer" in wanted
        if not whole and not any(isinstance(value, kinds[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in wanted):
            return [*out, f"{here}: type"]
    if "enum" in schema and _plain(value) not in map(_plain, schema["enum"]):
        out.append(f"{here}: enum")
    if "const" in schema and _plain(value) != _plain(schema["const"]):
        out.append(f"{here}: const")
    for rule in schema.get("allOf", ()):
        out += sub(value, rule)
    if "anyOf" in schema and all([sub(value, rule) for rule in schema["anyOf"]]):
        out.append(f"{here}: anyOf")
    if "oneOf" in schema and sum(not sub(value, rule) for rule in schema["oneOf"]) != 1:
        out.append(f"{here}: oneOf")
    if "not" in schema and not sub(value, schema["not"]):
        out.append(f"{here}: not")
    if "if" in schema:
        out += sub(value, schema.get("else" if sub(value, schema["if"]) else "then", True))
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}/{k}: required" for k in schema.get("required", ()) if k not in value]
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            out.append(f"{here}: size")
        for k, v in value.items():
            rules = [known[k]] if k in known else []
            rules += [rule for p, rule in patterns.items() if re.search(p, k)]
            for rule in rules:
                out += sub(v, rule, f"{at}/{k}")
            if not rules:
                rest = schema.get("additionalProperties", True)
                out += [f"{at}/{k}: unknown"] if rest is False else sub(v, rest, f"{at}/{k}")
            if "propertyNames" in schema and sub(k, schema["propertyNames"]):
                out.append(f"{at}/{k}: name")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{here}: size")
        if schema.get("uniqueItems") and len(set(map(_plain, value))) < len(value):
            out.append(f"{here}: unique")
        if "contains" in schema and all([sub(v, schema["contains"]) for v in value]):
            out.append(f"{here}: contains")
        # a list of items is draft 7's prefixItems
        items = schema.get("items", True)
        first, rest = (items, schema.get("additionalItems", True)) if isinstance(items, list) else (schema.get("prefixItems", []), items)
        for n, v in enumerate(value):
            out += sub(v, first[n] if n < len(first) else rest, f"{at}/{n}")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{here}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{here}: pattern")
        if "format" in schema:
            if schema["format"] not in _FORMATS:
                raise ValueError(f"a format that isn't checked: {schema['format']}")
            if not re.fullmatch(_FORMATS[schema["format"]], value):
                out.append(f"{here}: format")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{here}: range")
        if ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]) or ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]):
            out.append(f"{here}: range")
        if "multipleOf" in schema and not float(value / schema["multipleOf"]).is_integer():
            out.append(f"{here}: multiple")
    return out


def archive_issues(path: str, index_schema: dict, bank_schema: dict) -> dict[str, list[str]]:
    """What breaks the schemas in an archive's index.json and each of its term_bank_N.json members, by member."""
    import re
    import zipfile

    with zipfile.ZipFile(path) as z:
        banks = [n for n in z.namelist() if re.fullmatch(r"term_bank_\d+\.json", n)]
        return {n: schema_issues(json.loads(z.read(n)), index_schema if n == "index.json" else bank_schema) for n in ("index.json", *banks)}


def checked_by_schema(df: DataFrame, body: str, schema: dict) -> DataFrame:
    """Adds ``issues``."""

    @F.pandas_udf("array<string>")
    def check(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else schema_issues(json.loads(b), schema))

    return df.withColumn("issues", check(body))


def output_struct(units: list[dict]) -> str:
    """DDL of the response to a manifest: each unit a field, a list where the unit is a set."""
    kinds = {"glossary_set": "array<string>"}
    return ", ".join(f"`{u['unit_id']}` {kinds.get(u['role'], 'string')}" for u in units)


def verified_selection(path: str) -> dict:
    """A stored selection whose own digest still holds."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    if d.pop("sha256", None) != J.digest(d):
        raise ValueError("the selection was changed")
    return d


def approval(findings: DataFrame) -> DataFrame:
    """(identity, n) of findings, to be approved and compared with a later scan."""
    return findings.groupBy(F.sha2(F.to_json(F.struct(*sorted(findings.columns))), 256).alias("identity")).agg(F.count("*").alias("n"))


def gate(checks: dict[str, bool], required: set[str]) -> None:
    """A checklist passes if its keys are just the required ones and all hold."""
    if set(checks) != required:
        raise ValueError(f"other checks than required: {sorted(set(checks) ^ required)}")
    if failed := sorted(k for k, v in checks.items() if v is not True):
        raise ValueError(f"failed: {failed}")


def metadata_issues(meta: dict, updatable: bool) -> list[str]:
    """All of the update fields or none, as the kind asks, and no local address."""
    fields = ("indexUrl", "downloadUrl", "isUpdatable")
    have = [f for f in fields if meta.get(f)]
    out = [] if have == (list(fields) if updatable else []) else ["update fields"]
    return out + [f"local: {k}" for k, v in meta.items() if isinstance(v, str) and any(x in v for x in ("localhost", "127.0.0.1", "file://"))]


def built_index(source: dict, *, title: str, author: str, url: str, languages: tuple[str, str], description: str, revision: str, version: str, update: tuple[str, str] | None = None, foreign: tuple[str, ...] = ()) -> dict:
    """An archive's index: own metadata, of the source's only format, sequencing and attribution; ``update`` is the index's and the archive's URL.

    An error if the revision lacks ``v`` and the version, a URL has a word of ``foreign`` or :func:`metadata_issues` has anything.
    """
    index = {
        "title": title,
        "revision": revision,
        "format": source.get("format", 3),
        "sequenced": source.get("sequenced", True),
        "author": author,
        "description": description,
        "attribution": source.get("attribution", ""),
        "sourceLanguage": languages[0],
        "targetLanguage": languages[1],
        "url": url,
    }
    if update:
        index |= {"isUpdatable": True, "indexUrl": update[0], "downloadUrl": update[1]}
    issues = metadata_issues({k: index[k] for k in ("url", "isUpdatable", "indexUrl", "downloadUrl") if k in index}, update is not None)
    if f"v{version}" not in revision:
        issues.append("revision")
    issues += [f"foreign: {k}" for k in ("url", "indexUrl", "downloadUrl") if any(x.lower() in index.get(k, "").lower() for x in foreign)]
    if issues:
        raise ValueError(f"metadata: {issues}")
    return index


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of two versions beside each other; an error in the job if one side lacks a row."""
    x = a.select(*keys, *[F.col(c).alias(f"{c}_original") for c in columns], F.lit(True).alias("__x"))
    y = b.select(*keys, *[F.col(c).alias(f"{c}_current") for c in columns], F.lit(True).alias("__y"))
    ok = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    first = F.when(ok, F.col(keys[0])).otherwise(F.raise_error(F.lit("a row is on one side only")))
    return x.join(y, keys, "full_outer").select(first.alias(keys[0]), *keys[1:], *[f"{c}_{s}" for c in columns for s in ("original", "current")])


def refreshed(text: Column, pattern: str, new: str) -> Column:
    """The text with the one match of a pattern replaced; an error if there isn't just one."""
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, pattern, new)).otherwise(F.raise_error(F.lit("not one match")))


def sample_envelopes(spark: SparkSession, n: int) -> DataFrame:
    """Made-up envelopes (id, units, size) for tests and measurements."""
    return spark.range(n).select("id", (F.col("id") % 7 + 1).alias("units"), (11 * (F.col("id") % 11 + 1) * (F.col("id") % 7 + 1) + 80).alias("size"))


def missing_translations(versions: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """One row: how many rows of the first version each other one lacks."""
    (_, base), *others = versions.items()
    j = base.select(*keys)
    for name, v in others:
        j = j.join(v.select(*keys, F.col(value).alias(f"__{name}")), keys, "left")
    return j.agg(*[F.count_if(F.col(f"__{n}").isNull()).alias(n) for n, _ in others])
