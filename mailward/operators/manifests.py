"""Run manifests as data: JSON documents checked against exact key sets, kinds and the facts that they state.

A document is parsed once into VARIANT, natively; a document that is no JSON, or repeats a key anywhere, parses
to null. Its identity is the SHA-256 of a domain string, a zero byte and its canonical form: keys sorted at every
level, no white space, numbers without trailing zeros, the run_id left out, and the root's identifier too where
a fresh run is its own root. So any change of a fact changes the identity, and the order of keys does not. The
exact bytes have a digest of their own, by which later runs name a manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_json
from ..sources.folders import hadoop_path
from .store import RUN_RULES

# Keys of a run manifest of version 2, in the order of its groups, and of the first version's, with the kind of each value.
V2 = {
    "manifest_schema_version": "count", "run_id": "sha256", "previous_run_manifest_sha256": "sha256?", "input_sqlite_sha256": "sha256?", "input_sqlite_size_bytes": "count?", "output_sqlite_sha256": "sha256", "output_sqlite_size_bytes": "count",
    "source_input_normalized_sha256": "sha256", "source_input_normalized_line_count": "positive", "planned_input_normalized_sha256": "sha256", "planned_input_normalized_line_count": "count", "attempted_input_normalized_sha256": "sha256", "attempted_input_normalized_line_count": "count",
    "planned_excluded_count": "count", "rows_written": "count", "database_pre": "accounting", "database_post": "accounting", "scanner_git_revision": "sha1", "scanner_git_dirty": "flag", "resolver_configuration": "resolver", "started_at_utc": "time", "finished_at_utc": "time",
    "concurrency": "positive", "batch_pool_size": "positive", "run_mode": "text", "limit": "count?", "shuffle": "flag", "shuffle_seed": "count?", "planned_input_order": "text", "python_version": "text",
    "measurement_core_algorithm": "text", "measurement_core_files": "texts", "measurement_core_sha256": "sha256", "measurement_core_transition": "any", "root_measurement_core_attestation": "root", "release_eligible": "flag",
}
V1 = {
    "normalized_input_sha256": "sha256", "normalized_input_line_count": "positive", "source_input_normalized_sha256": "sha256", "source_input_normalized_line_count": "positive", "effective_input_normalized_sha256": "sha256", "effective_input_normalized_line_count": "count",
    "scanner_git_revision": "sha1", "scanner_git_dirty": "flag", "resolver_configuration": "resolver", "started_at_utc": "time", "finished_at_utc": "time", "concurrency": "positive", "batch_pool_size": "positive", "retry_resume_mode": "text",
    "limit": "count?", "shuffle": "flag", "shuffle_seed": "count?", "effective_input_order": "text", "python_version": "text", "output_sqlite_sha256": "sha256", "output_sqlite_size_bytes": "count",
}
NESTED = {
    "accounting": {"total_rows": "count", "analyzable_rows": "count", "error_rows": "count"},
    "resolver": {"nameservers": "texts", "rotate": "flag", "timeout_seconds": "number", "lifetime_seconds": "number", "cache_policy": "text", "dnspython_version": "text"},
    "root": {"root_identifier_kind": "text", "root_identifier": "sha256", "manifest_schema_version": "positive", "scanner_git_revision": "sha1", "measurement_core_sha256": "sha256", "attestation_method": "text"},
}
ORDERS = {True: "seeded_shuffle_then_limit", False: "source_order_then_limit"}

_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
_HEX = {"sha256": r"^[0-9a-f]{64}$", "sha1": r"^[0-9a-f]{40}$"}


def _part(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _once(value: Column, build) -> Column:
    """build(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _keys(v: Column) -> Column:
    return F.array_sort(F.json_object_keys(F.to_json(v)))


def _names(fields) -> Column:
    return F.array(*[F.lit(f) for f in sorted(fields)])


def is_kind(v: Column, kind: str) -> Column:
    """Whether a VARIANT value is of a kind; a missing one is of none."""
    own = F.schema_of_variant(v)
    if kind.endswith("?"):
        return F.coalesce(own == "VOID", F.lit(False)) | is_kind(v, kind[:-1])
    if kind in NESTED:
        inside = NESTED[kind]
        held = F.coalesce(_keys(v) == _names(inside), F.lit(False))
        for field, each in inside.items():
            held = held & is_kind(_part(v, field), each)
        return held
    if kind in ("count", "positive"):
        test = (own == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= (1 if kind == "positive" else 0))
    elif kind in _HEX:
        test = (own == "STRING") & F.rlike(_text(v), F.lit(_HEX[kind]))
    elif kind == "time":
        test = (own == "STRING") & F.rlike(_text(v), F.lit(_TIME)) & F.try_to_timestamp(_text(v)).isNotNull()
    elif kind == "number":
        test = own.isin("BIGINT", "DOUBLE") | F.startswith(own, F.lit("DECIMAL"))
    else:
        test = own.isin(*{"flag": ["BOOLEAN"], "text": ["STRING"], "texts": ["ARRAY<STRING>"], "any": ["VOID", "STRING"]}[kind]) | (F.startswith(own, F.lit("OBJECT")) if kind == "any" else F.lit(False))
    return F.coalesce(test, F.lit(False))


def _misfit(field: str, kind: str):
    """What a stated value of another kind is called."""
    return lambda p: F.when(p.isNotNull() & ~is_kind(p, kind), F.lit(f"kind:{field}"))


def canonical(v: Column, leave_out: str | None = None) -> Column:
    """The canonical text of a VARIANT object, one key of its own left out; null for anything else.

    A VARIANT keeps an object's keys sorted, so its JSON is the canonical text if that is all ASCII (others may be
    sorted by another encoding), and a key whose name stands there once can be cut out of it. All else goes field by field.
    """
    def shortened(text: Column) -> Column:
        plain = F.startswith(text, F.lit("{")) & (F.length(text) == F.octet_length(text))
        if not leave_out:
            return F.when(plain, text)
        key = f'"{leave_out}":'

        def without(field: Column) -> Column:
            once = F.length(text) - F.length(F.replace(text, F.lit(key), F.lit(""))) == len(key)
            after, before = F.concat(field, F.lit(",")), F.concat(F.lit(","), field)
            return F.when(plain & once & F.contains(text, after), F.replace(text, after, F.lit(""))).when(plain & once & F.contains(text, before), F.replace(text, before, F.lit("")))

        return _once(F.concat(F.lit(key), F.to_json(_part(v, leave_out))), without)

    return F.coalesce(_once(F.to_json(v), shortened), _by_fields(v, leave_out))


def _by_fields(v: Column, leave_out: str | None = None) -> Column:
    """canonical() from the fields one by one."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    kept = F.filter(F.array_sort(F.map_keys(fields)), lambda k: k != leave_out) if leave_out else F.array_sort(F.map_keys(fields))
    # A key as JSON text is what its one-element list shows between the brackets.
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda k: F.concat(F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1), F.lit(":"), F.to_json(fields[k]))), ","), F.lit("}"))


def identity(v: Column, domain: str = "mail-run-v2") -> Column:
    """The run_id that a manifest's facts give it."""
    root = "root_measurement_core_attestation"
    own = F.regexp_replace(canonical(v, "run_id"), r'(?<="root_identifier":)"[0-9a-f]{64}"', "null")
    fresh = F.coalesce(F.try_variant_get(v, "$.run_mode", "string") == "fresh", F.lit(False)) & F.coalesce(F.startswith(F.schema_of_variant(_part(v, root)), F.lit("OBJECT")), F.lit(False))
    return F.sha2(F.concat(F.lit(domain + "\0"), F.when(fresh, own).otherwise(canonical(v, "run_id"))).cast("binary"), 256)


def facts(v: Column) -> dict[str, Column]:
    """Typed facts of a version 2 manifest; null where a value is of another type."""
    def at(path, kind):
        return F.try_variant_get(v, f"$.{path}", kind)

    counts = {"planned": "planned_input_normalized_line_count", "excluded": "planned_excluded_count", "attempted": "attempted_input_normalized_line_count", "written": "rows_written", "source_count": "source_input_normalized_line_count", "limit_rows": "limit", "seed": "shuffle_seed"}
    sides = {f"{side}_{k}": f"database_{side}.{full}" for side in ("pre", "post") for k, full in (("total", "total_rows"), ("ok", "analyzable_rows"), ("error", "error_rows"))}
    texts = {"run_id": "run_id", "previous": "previous_run_manifest_sha256", "input": "input_sqlite_sha256", "run_order": "planned_input_order", "root_id": "root_measurement_core_attestation.root_identifier", "root_core": "root_measurement_core_attestation.measurement_core_sha256", "core": "measurement_core_sha256"}
    return {
        **{k: at(p, "bigint") for k, p in {**counts, **sides}.items()}, **{k: at(p, "string") for k, p in texts.items()},
        "run_mode": F.when(at("run_mode", "string") == "resume_retry_partial_errors", "resume").otherwise(at("run_mode", "string")),
        "started": F.try_to_timestamp(at("started_at_utc", "string")), "finished": F.try_to_timestamp(at("finished_at_utc", "string")),
        "dirty": at("scanner_git_dirty", "boolean"), "shuffle": at("shuffle", "boolean"), "release_eligible": at("release_eligible", "boolean"),
    }


_ELIGIBLE = "limit_rows IS NULL AND NOT dirty AND planned = source_count AND post_total = source_count AND IF(run_mode = 'fresh', attempted = source_count, pre_total = source_count)"
# What the facts of a version 2 manifest must satisfy, as conditions; null counts as broken.
FACT_RULES = {
    "interval": "finished >= started",
    "run_order": f"run_order = IF(shuffle, '{ORDERS[True]}', '{ORDERS[False]}') AND IF(shuffle, seed IS NOT NULL, seed IS NULL)",
    "planned": "planned = coalesce(least(source_count, limit_rows), source_count)",
    "links": "IF(run_mode = 'fresh', previous IS NULL AND input IS NULL, previous IS NOT NULL AND input IS NOT NULL AND limit_rows IS NULL)",
    "root": "run_mode <> 'fresh' OR (root_id = run_id AND root_core = core)",
    **RUN_RULES,
    "eligible": f"release_eligible = ({_ELIGIBLE})",
    "identity": "run_id = own_identity",
}


def violations(documents: DataFrame) -> DataFrame:
    """name, version and the codes of what documents(name, text) break, in order, comma-joined.

    json: no JSON object, or a repeated key. version: neither 2 nor the first, which has no version. keys: another
    set of keys. kind:<field>: a value of another kind, nested ones by their outer field. Then, of version 2 documents
    whose keys and kinds are right, the names of the broken FACT_RULES. A null text is no JSON.
    """
    v = F.col("v")
    parsed = documents.select("name", parsed_json(F.col("text")).alias("v"))
    kept = parsed.withColumn("v", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))
    number = F.try_variant_get(v, "$.manifest_schema_version", "bigint")
    stated = _part(v, "manifest_schema_version")
    kept = kept.withColumn("version", F.when(v.isNull(), None).when(stated.isNull(), 1).when(number == 2, 2))
    forms = F.array().cast("array<string>")
    for version, spec in ((1, V1), (2, V2)):
        wrong = [F.when(_keys(v) != _names(spec), F.lit("keys")), *[_once(_part(v, f), _misfit(f, k)) for f, k in spec.items()]]
        forms = F.when(F.col("version") == version, F.array_compact(F.array(*wrong))).otherwise(forms)
    kept = kept.withColumn("forms", F.when(v.isNull(), F.array(F.lit("json"))).when(F.col("version").isNull(), F.array(F.lit("version"))).otherwise(forms))
    stated_facts = kept.select("name", "version", "forms", F.when(F.size("forms") == 0, identity(v)).alias("own_identity"), *[x.alias(k) for k, x in facts(v).items()])
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(k)) for k, p in FACT_RULES.items()]))
    codes = F.when((F.size("forms") == 0) & (F.col("version") == 2), broken).otherwise(F.col("forms"))
    return stated_facts.select("name", F.col("version").cast("int").alias("version"), F.array_join(codes, ",").alias("codes"))


def document(fields: dict[str, Column]) -> Column:
    """A version 2 manifest's text from columns of its fields, its run_id filled in; fields are V2 without run_id.

    A field's column may have any type that JSON has; nested ones are structs. Columns that are null are JSON nulls.
    """
    if set(fields) != set(V2) - {"run_id"}:
        raise ValueError(f"fields: {sorted(set(fields) ^ (set(V2) - {'run_id'}))}")
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    run_id = identity(F.parse_json(body))
    named = F.concat(F.lit('{"run_id":"'), run_id, F.lit('",'), F.substring(body, 2, 2**31 - 1))
    root = F.regexp_replace(named, r'(?<="root_identifier":)null', F.concat(F.lit('"'), run_id, F.lit('"')))
    return F.when(fields["run_mode"] == "fresh", root).otherwise(named)


def run_facts(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts of a run, from one aggregate over its plan(domain) and the results (domain, error, query_statuses) before and after."""
    from .store import inconclusive

    def side(rows, name):
        return rows.select(F.lit(name).alias("side"), "domain", inconclusive().alias("bad"))

    rows = plan.select(F.lit("plan").alias("side"), "domain", F.lit(False).alias("bad")).unionByName(side(before, "pre")).unionByName(side(after, "post"))
    per = rows.groupBy("domain").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("plan", "pre", "post")], F.count_if((F.col("side") == "pre") & F.col("bad")).alias("pre_bad"), F.count_if((F.col("side") == "post") & F.col("bad")).alias("post_bad"))
    done = (F.col("pre") > 0) & (F.col("pre_bad") == 0)
    return per.agg(
        F.sum("plan").alias("planned"), F.count_if((F.col("plan") > 0) & done).alias("excluded"), F.count_if((F.col("plan") > 0) & ~done).alias("attempted"),
        F.sum("pre").alias("pre_total"), F.sum("pre_bad").alias("pre_error"), F.sum("post").alias("post_total"), F.sum("post_bad").alias("post_error"),
    ).na.fill(0).withColumns({"pre_ok": F.col("pre_total") - F.col("pre_error"), "post_ok": F.col("post_total") - F.col("post_error")})


def archived(spark: SparkSession, text: str, folder: str) -> str:
    """Keep a manifest under its digest: written aside, renamed, never overwritten. Returns the digest."""
    import hashlib
    import uuid

    data = text.encode()
    digest = hashlib.sha256(data).hexdigest()
    store, target = hadoop_path(spark, f"{folder}/{digest}.json")
    if store.exists(target):
        if stored_texts(spark, folder).filter(F.col("name") == f"{digest}.json").filter(F.col("sha256") != digest).count():
            raise ValueError(f"{digest}.json holds other bytes")
        return digest
    _, aside = hadoop_path(spark, f"{folder}/.{digest}.{uuid.uuid4().hex}")
    out = store.create(aside)
    out.write(bytearray(data))
    out.close()
    if not store.rename(aside, target) and not store.exists(target):
        raise OSError(f"cannot keep {digest}.json")
    return digest


def stored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """name, text and sha256 of every manifest of a folder; text is null where the bytes are no UTF-8."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("text"), F.sha2("content", 256).alias("sha256"))


def discovered(spark: SparkSession, folder: str, least: int = 2) -> DataFrame:
    """stored_texts(), if there are enough files and each is named by its digest."""
    found = stored_texts(spark, folder)
    n, wrong = found.agg(F.count(F.lit(1)), F.count_if(F.col("name") != F.concat("sha256", F.lit(".json")))).first()
    if n < least or wrong:
        raise ValueError(f"{n} manifests, {wrong} of them not named by their digest")
    return found
