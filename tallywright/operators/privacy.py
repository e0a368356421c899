"""Redaction, de-identification, safety rules, retention and subject requests."""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import fixed, text as tx
from tallywright.operators.filters import denied
from tallywright.operators.scalars import strip_html


# A text without the sign of a rule cannot match it and skips the rule; fixed values, one per secret rule in order.
SECRET_SIGNS = ["A(KI|SI|ID|RO)A", "(?i)AWS4-HMAC", "(?i)signature=", "[?&]", "(?i)bearer", "eyJ", "://", "[=:]"]


def redact_secrets(c: Column) -> Column:
    """PR01. Secrets replaced in the order of the rules."""
    state = F.array(F.coalesce(c, F.lit("")))
    for (pattern, flags, to), sign in zip(fixed.SECRET_RULES, SECRET_SIGNS):
        # One-element arrays bind the text of each step, so every step is taken once.
        state = F.transform(state, lambda x: F.when(x.rlike(sign), tx.replace_all(x, pattern, to, "i" in flags)).otherwise(x))
    return state[0]


def _scrub_steps() -> list[tuple[str, str, list[tuple[str, str]]]]:
    """(category, sign without which nothing matches, [(pattern, replacement)]) in order; a two-digit year becomes 20xx up to
    69, else 19xx."""
    def years(head: str) -> list[tuple[str, str]]:
        plain = (r"([1-9][0-9]{2,3})\b", r"0([1-9][0-9]{1,2})\b", r"00([1-9][0-9]?)\b", r"000([0-9])\b", r"00(0)\b")
        return [(head + r"([0-6][0-9])\b", "20$3"), (head + r"([7-9][0-9])\b", "19$3"), *((head + x, "$3") for x in plain)]
    day, sep = r"\b([0-9]{1,2})", "([0-9]{1,2})"
    return [
        ("email", "@", [(fixed.EMAIL, "[EMAIL-REDACTED]")]), ("phone", "[0-9]{4}", [(fixed.PHONE, "[PHONE-REDACTED]")]),
        ("ssn", "[0-9]{4}", [(fixed.SSN, "[SSN-REDACTED]")]), ("url", "://", [(fixed.URL, "[URL-REDACTED]")]),
        ("ip_address", r"[0-9]\.[0-9]", [(fixed.IP_ADDRESS, "[IP-REDACTED]")]), ("geo_sub_state", r"[0-9]\s", [(fixed.STREET, "[ADDRESS-REDACTED]")]),
        ("names", "Dr|M[rs]|Pt|Patient", [(fixed.HONORIFIC, "$1. [NAME-REDACTED]")]),
        ("dates_full", "[0-9]-[0-9]{2}-[0-9]", [(r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", "$1")]),
        ("dates_full", "[0-9]{4}", [(rf"(?i)\b({fixed.MONTHS})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b", "$3")]),
        ("dates_full", "[0-9]-[A-Za-z]{3,9}-[0-9]", years(day + "-([A-Za-z]{3,9})-")), ("dates_full", "[0-9]-[0-9]{1,2}-[0-9]", years(day + "-" + sep + "-")),
        ("dates_full", "[0-9]/[0-9]{1,2}/[0-9]", years(day + "/" + sep + "/")),
    ]


def scrub_free_text(c: Column) -> Column:
    """PR02. struct(t: text without identifiers, c: categories found). Each step tests and replaces the text as it stands then.

    A text without any sign is left as it is after one look. A step that matched changed the text, since the rules of a step with several of them all
    shorten it, so the category needs no second look. One-element arrays bind the text of each step, which keeps the expression linear in the number of steps.
    """
    steps = _scrub_steps()
    state = F.array(F.struct(F.coalesce(c, F.lit("")).alias("t"), F.array().cast("array<string>").alias("c")))
    some = "|".join(dict.fromkeys(sign for _, sign, _ in steps))

    def apply(x: Column, rules: list[tuple[str, str]]) -> Column:
        for pattern, to in rules:
            x = tx.replace_all(x, pattern, to)
        return x

    def scrubbed(x: Column) -> Column:
        done = F.array(x)
        for category, sign, rules in steps:
            done = F.transform(F.transform(done, lambda x: F.struct(F.when(x["t"].rlike(sign), apply(x["t"], rules)).otherwise(x["t"]).alias("n"), x.alias("x"))), lambda y: F.struct(
                y["n"].alias("t"), F.when(y["n"] != y["x"]["t"], F.array_append(y["x"]["c"], F.lit(category))).otherwise(y["x"]["c"]).alias("c")))
        return done[0]

    return F.transform(state, lambda x: F.when(x["t"].rlike(some), scrubbed(x)).otherwise(x))[0]


def scrub_table(df: DataFrame, text: str) -> DataFrame:
    """PR02 as a table job."""
    d = df.withColumn("_s", scrub_free_text(F.col(text)))
    return d.withColumn(text, F.col("_s.t")).withColumn("categories", F.array_sort(F.array_distinct("_s.c"))).drop("_s")


# De-identification of nested records -----------------------------------------------------------------------------------

# Key classes, fixed values: (keys, category, mask).
KEY_CLASSES = [
    (["name", "first_name", "last_name", "full_name", "patient_name", "customer_name", "given_name", "family_name", "middle_name", "maiden_name",
      "guardian_name", "next_of_kin", "emergency_contact_name", "physician_name", "provider_name", "employer_name"], "names", "[NAME-REDACTED]"),
    (["address", "street", "street_address", "address_line1", "address_line2", "city", "county", "precinct", "shipping_address", "billing_address",
      "location"], "geo_sub_state", "[GEO-REDACTED]"),
    (["phone", "phone_number", "telephone", "mobile", "cell", "home_phone", "work_phone", "contact_phone"], "phone", "[PHONE-REDACTED]"),
    (["fax", "fax_number"], "fax", "[FAX-REDACTED]"),
    (["email", "email_address", "contact_email"], "email", "[EMAIL-REDACTED]"),
    (["ssn", "social_security_number", "social_security", "ssn_alt"], "ssn", "[SSN-REDACTED]"),
    (["mrn", "medical_record_number", "medical_record_num", "patient_id", "chart_number"], "mrn", "[MRN-REDACTED]"),
    (["health_plan_id", "beneficiary_number", "insurance_id", "member_id", "member_number", "policy_number", "insurance_policy_no", "claim_number"],
     "health_plan_number", "[HEALTHPLAN-REDACTED]"),
    (["account_number", "account_id", "customer_account_number", "billing_account", "billing_acct_no", "employee_number"], "account_number", "[ACCOUNT-REDACTED]"),
    (["license_number", "certificate_number", "certification_number", "professional_license", "npi_number"], "certificate_license_number", "[LICENSE-REDACTED]"),
    (["vin", "vehicle_id", "vehicle_serial", "license_plate", "plate_number", "plate"], "vehicle_identifier", "[VEHICLE-ID-REDACTED]"),
    (["device_id", "device_serial", "serial_number", "imei", "udid", "hearing_aid_serial", "hearing_aid_sn"], "device_identifier", "[DEVICE-ID-REDACTED]"),
    (["url", "website", "profile_url", "photo_url", "avatar_url", "homepage"], "url", "[URL-REDACTED]"),
    (["ip", "ip_address", "last_ip", "client_ip", "network_addr"], "ip_address", "[IP-REDACTED]"),
    (["fingerprint", "voiceprint", "retinal_scan", "biometric_id", "faceprint", "fingerprint_hash"], "biometric_identifier", "[BIOMETRIC-REDACTED]"),
    (["photo", "face_photo", "headshot", "image", "photo_data", "profile_pic"], "full_face_photo", "[PHOTO-REDACTED]"),
]
ZIP_KEYS = ["zip", "zipcode", "zip_code", "postal_code"]
AGE_KEYS = ["age", "age_at_note", "patient_age", "age_years"]
DATE_KEYS = ["dob", "date_of_birth", "birth_date", "admission_date", "discharge_date", "death_date", "date_of_death", "visit_date", "service_date",
             "note_date", "purchased_at", "created_at", "updated_at", "order_date", "screening_date", "appointment_date", "encounter_date"]
DOB_KEYS = ["dob", "date_of_birth", "birth_date"]
SAFE_KEYS = ["age_band", "ear", "result_category_tier", "result_severity_band", "device", "synthetic", "sex", "state", "state_code", "region", "dx_code",
             "dx_description", "subtotal", "tax", "total", "order_total", "amount", "amount_total", "grand_total", "discount", "shipping", "shipping_cost",
             "currency", "quantity", "qty", "unit_price", "price", "line_total", "product", "title", "financial_status", "fulfillment_status"]
TEXT_KEYS = ["note", "notes", "comment", "comments", "description", "summary", "narrative"]
GENERIC_ID = r"(^id$|_id$|^uuid$|_uuid$|record_id|external_id|customer_id|patient_id|order_number|record_number)"
ID_SHAPES = [
    (r"(?i)^(mr|mrn)[-\s]?[0-9]{4,}$", "mrn"), (r"(?i)^(acct|account)[-\s]?[0-9]{4,}$", "account_number"), (r"(?i)^[A-HJ-NPR-Z0-9]{17}$", "vehicle_identifier"),
    (r"(?i)^(ha|dev|sn|serial)[-\s]?[\w-]{4,}$", "device_identifier"), (r"^[A-Z]{2,6}-[0-9]{2,4}(-[0-9]{2,})?$", "other_unique_identifier"),
]
ALLOWED_ZIP3: list[str] = []


def zip3(c: Column, allowed: Sequence[str] = ALLOWED_ZIP3) -> Column:
    """PR05. First three digits with two zeros when the prefix is allowed, else 000."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    p = F.substring(digits, 1, 3)
    return F.when((F.length(digits) >= 3) & p.isin(*allowed), F.concat(p, F.lit("00"))).otherwise("000") if allowed else F.lit("000")


def over_89(schema: T.StructType, year: int, at: Column | None = None) -> Column:
    """PR04. True when any age of the record is over 89 or any birth year lies more than 89 years back; arrays are not searched."""
    flag = F.lit(False)
    for f in schema:
        v = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
        k = f.name.lower()
        if isinstance(f.dataType, T.StructType):
            flag = flag | over_89(f.dataType, year, v)
        elif k in AGE_KEYS:
            flag = flag | F.coalesce(v.cast("string").try_cast("double") > 89, F.lit(False))
        elif k in DOB_KEYS:
            y = F.regexp_extract(v.cast("string"), r"([0-9]{4})", 1).try_cast("int")
            flag = flag | F.coalesce(F.lit(year) - y > 89, F.lit(False))
    return flag


NOTHING = "array<string>"


def _none() -> Column:
    return F.array().cast(NOTHING)


def _judged(value: Column | None, cats: Column, gone: Column) -> Column:
    """What is known of one leaf: its masked value, the categories found, and its key if the value is dropped."""
    return F.struct(*([] if value is None else [value.alias("m")]), cats.alias("c"), gone.alias("d"))


def _shape(v: Column) -> Column:
    """struct(m, c) of the identifier that a whole text has the shape of, else null."""
    out = None
    for pattern, cat in ID_SHAPES:
        made = F.struct(F.lit("[" + cat.upper().replace("_", "-") + "-REDACTED]").alias("m"), F.array(F.lit(cat)).alias("c"))
        out = F.when(F.trim(v).rlike(pattern), made) if out is None else out.when(F.trim(v).rlike(pattern), made)
    return out


def _date(v: Column, s: Column, birth: Column, old: Column) -> tuple[Column, Column]:
    y = F.regexp_extract(s, r"([0-9]{4})", 1)
    hidden = birth & old
    cats = F.when(hidden, F.array(F.lit("dates_full"), F.lit("dob_year_over_89_suppressed"))).otherwise(F.array(F.lit("dates_full")))
    return F.when(v.isNotNull(), F.when(hidden, "REDACTED-90+").when(y != "", y).otherwise("REDACTED-DATE")), F.when(v.isNotNull(), cats).otherwise(_none())


def _text(key: Column, v: Column, kept: Column, scrubs: bool) -> Column:
    """A text: the mask of its shape, else scrubbed where it is ``kept``, else dropped. It is looked at once; the one-element array binds what is found."""
    scrubbed = F.when(kept & v.isNotNull(), scrub_free_text(v)) if scrubs else F.lit(None).cast("struct<t: string, c: array<string>>")

    def judge(x: Column) -> Column:
        hit, s = x["hit"], x["s"]
        return _judged(F.when(hit.isNotNull(), hit["m"]).otherwise(s["t"]), F.coalesce(hit["c"], s["c"], _none()),
                       F.when(v.isNull() | hit.isNotNull() | kept, _none()).otherwise(F.array(key)))

    return F.transform(F.transform(F.array(_shape(v)), lambda hit: F.struct(hit.alias("hit"), F.when(hit.isNull(), scrubbed).alias("s"))), judge)[0]


def _leaf(key: str, kind: T.DataType, old: Column, zips: Sequence[str]) -> tuple[Callable[[Column], Column], bool]:
    """(judge of a value under a key known from the schema, whether any value of the key is kept)."""
    def judge(v: Column) -> Column:
        s = v.cast("string")
        found = lambda cat: F.when(v.isNotNull(), F.array(F.lit(cat))).otherwise(_none())
        for keys, cat, mask in KEY_CLASSES:
            if key in keys:
                return _judged(F.when(v.isNotNull(), F.lit(mask)), found(cat), _none())
        if key in ZIP_KEYS:
            return _judged(F.when(v.isNotNull(), zip3(v, zips)), found("geo_zip"), _none())
        if key in AGE_KEYS:
            high = F.coalesce(s.try_cast("double") > 89, F.lit(False))
            return _judged(F.when(high, "90+").otherwise(s), F.when(high, F.array(F.lit("age_over_89"))).otherwise(_none()), _none())
        if key in DATE_KEYS or key.endswith("date") or key.endswith("_at"):
            return _judged(*_date(v, s, F.lit(key in DOB_KEYS), old), _none())
        if re.search(GENERIC_ID, key) and key not in SAFE_KEYS:
            return _judged(F.when(v.isNotNull(), F.lit("[ID-REDACTED]")), found("other_unique_identifier"), _none())
        if not isinstance(kind, T.StringType):
            return _judged(v, _none(), _none()) if safe else _judged(None, _none(), found(key))
        kept = safe or key in TEXT_KEYS
        return _text(F.lit(key), v, F.lit(kept), kept)

    safe = key in SAFE_KEYS or bool(re.fullmatch(r"\d+hz_band", key))
    classed = any(key in keys for keys, _, _ in KEY_CLASSES) or key in ZIP_KEYS or key in AGE_KEYS or key in DATE_KEYS or key.endswith(("date", "_at"))
    return judge, isinstance(kind, T.StringType) or safe or classed or bool(re.search(GENERIC_ID, key))


def _entry(kind: T.DataType, old: Column, zips: Sequence[str]) -> Callable[[Column, Column], Column]:
    """Judge of (key, value) of a map, whose keys are only known row by row: the classes of :func:`_leaf` in the same order. Values are texts from here on."""
    def judge(name: Column, v: Column) -> Column:
        key, s = F.lower(name), v.cast("string")
        found = lambda cat: F.when(v.isNotNull(), F.array(F.lit(cat))).otherwise(_none())
        masked = lambda value, cats: _judged(value, cats, _none())
        out = None
        add = lambda test, value: F.when(test, value) if out is None else out.when(test, value)
        for keys, cat, mask in KEY_CLASSES:
            out = add(key.isin(*keys), masked(F.when(v.isNotNull(), F.lit(mask)), found(cat)))
        out = add(key.isin(*ZIP_KEYS), masked(F.when(v.isNotNull(), zip3(s, zips)), found("geo_zip")))
        high = F.coalesce(s.try_cast("double") > 89, F.lit(False))
        out = add(key.isin(*AGE_KEYS), masked(F.when(high, "90+").otherwise(s), F.when(high, F.array(F.lit("age_over_89"))).otherwise(_none())))
        out = add(key.isin(*DATE_KEYS) | key.endswith("date") | key.endswith("_at"), masked(*_date(v, s, key.isin(*DOB_KEYS), old)))
        out = add(key.rlike(GENERIC_ID) & ~key.isin(*SAFE_KEYS), masked(F.when(v.isNotNull(), F.lit("[ID-REDACTED]")), found("other_unique_identifier")))
        safe = key.isin(*SAFE_KEYS) | key.rlike(r"^[0-9]+hz_band$")
        if isinstance(kind, T.StringType):
            return out.otherwise(_text(key, v, safe | key.isin(*TEXT_KEYS), True))
        return out.otherwise(_judged(F.when(safe, s), _none(), F.when(safe | v.isNull(), _none()).otherwise(F.array(key))))
    return judge


class _Walk:
    """One place of the schema: ``judged`` makes of a value what is known of all its leaves, each judged once; ``value``, ``cats`` and ``gone`` read that."""

    def __init__(self, key: str, kind: T.DataType, old: Column, zips: Sequence[str]):
        flat = lambda many: F.coalesce(F.flatten(many), _none())
        if isinstance(kind, T.StructType):
            parts = [(f.name, f"p{k}", _Walk(f.name.lower(), f.dataType, old, zips)) for k, f in enumerate(kind)]
            stay = [(name, at, w) for name, at, w in parts if w.stays]
            self.stays = bool(stay)
            self.judged = lambda v: F.when(v.isNotNull(), F.struct(*[w.judged(v.getField(name)).alias(at) for name, at, w in parts]))
            self.value = lambda r: F.when(r.isNotNull(), F.struct(*[w.value(r[at]).alias(name) for name, at, w in stay]))
            self.cats = lambda r: flat(F.array(*[w.cats(r[at]) for _, at, w in parts]))
            self.gone = lambda r: flat(F.array(*[w.gone(r[at]) for _, at, w in parts]))
        elif isinstance(kind, T.ArrayType):
            inner = _Walk(key, kind.elementType, old, zips)
            self.stays = inner.stays
            self.judged = lambda v: F.transform(v, inner.judged)
            self.value = lambda r: F.transform(r, inner.value)
            self.cats = lambda r: flat(F.transform(r, inner.cats))
            self.gone = lambda r: flat(F.transform(r, inner.gone))
        elif isinstance(kind, T.MapType) and isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
            # Below a key of a map the names come from the schema again; the key itself is not looked at.
            inner = _Walk(key, kind.valueType, old, zips)
            self.stays = inner.stays
            self.judged = lambda v: F.transform(F.map_entries(v), lambda e: F.struct(e["key"].alias("k"), inner.judged(e["value"]).alias("r")))
            self.value = lambda r: F.map_from_entries(F.transform(r, lambda e: F.struct(e["k"], inner.value(e["r"]))))
            self.cats = lambda r: flat(F.transform(r, lambda e: inner.cats(e["r"])))
            self.gone = lambda r: flat(F.transform(r, lambda e: inner.gone(e["r"])))
        elif isinstance(kind, T.MapType):
            entry = _entry(kind.valueType, old, zips)
            self.stays = True
            self.judged = lambda v: F.transform(F.map_entries(v), lambda e: F.struct(e["key"].alias("k"), entry(e["key"].cast("string"), e["value"]).alias("r")))
            self.value = lambda r: F.map_from_entries(F.transform(F.filter(r, lambda e: F.size(e["r"]["d"]) == 0), lambda e: F.struct(e["k"], e["r"]["m"])))
            self.cats = lambda r: flat(F.transform(r, lambda e: e["r"]["c"]))
            self.gone = lambda r: flat(F.transform(r, lambda e: e["r"]["d"]))
        else:
            self.judged, self.stays = _leaf(key, kind, old, zips)
            self.value, self.cats, self.gone = (lambda r, f=f: r[f] for f in "mcd")
            self.cats, self.gone = (lambda r, g=g: F.coalesce(g(r), _none()) for g in (self.cats, self.gone))


UNCLASSIFIED = "dropped (unclassified)"


def deidentify_record(df: DataFrame, year: int, keep: Sequence[str] = (), zips: Sequence[str] = ALLOWED_ZIP3) -> DataFrame:
    """PR03. Nested records masked by key class; values of keys of no class are dropped and their keys named, record by record, in
    ``dropped_keys``, with the category "dropped (unclassified)".

    The schema is walked once; structs, arrays and maps keep their form. A map's entries are classed by their own keys, row by row, and its plain
    values become texts. Every leaf is judged once, in a first projection; the second takes values, categories and dropped keys from that. A
    text of no class stays only as a mask when it has the shape of an identifier. ``keep`` columns pass as they are.
    """
    schema = T.StructType([f for f in df.schema if f.name not in keep])
    d = df.withColumn("_old", over_89(schema, year))
    walks = [(f.name, f"_j{k}", _Walk(f.name.lower(), f.dataType, F.col("_old"), zips)) for k, f in enumerate(schema)]
    d = d.select(*keep, *[w.judged(F.col(f"`{name}`")).alias(at) for name, at, w in walks])
    merged = lambda parts: F.array_sort(F.array_distinct(F.flatten(F.array(*parts)))) if parts else _none()
    d = d.select(*keep, *[w.value(F.col(at)).alias(name) for name, at, w in walks if w.stays], merged([w.cats(F.col(at)) for _, at, w in walks]).alias("categories"), merged([w.gone(F.col(at)) for _, at, w in walks]).alias("dropped_keys"))
    return d.withColumn("categories", F.when(F.size("dropped_keys") > 0, F.array_sort(F.array_append("categories", F.lit(UNCLASSIFIED)))).otherwise(F.col("categories")))


def deid_report(clean: DataFrame) -> DataFrame:
    """PR06. Records per category, and the dropped keys; never a value. The records are worked out once for all three kinds.

    ``explode_outer``, as every record has a name at least: for ``explode`` Spark adds a filter on the names and works out every record for it once more.
    """
    named = lambda kind, names: F.transform(F.coalesce(names, _none()), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    each = F.concat(named("category", F.col("categories")), named("dropped_key", F.col("dropped_keys")), named("total", F.array(F.lit("records_processed"))))
    counted = clean.select(F.explode_outer(each).alias("_n")).select("_n.name", F.lit(1).cast("long").alias("_one"), "_n.kind")
    # The total of no records is 0 and not missing.
    zero = clean.sparkSession.range(1).select(F.lit("records_processed").alias("name"), F.lit(0).cast("long").alias("_one"), F.lit("total").alias("kind"))
    return counted.unionByName(zero).groupBy("name", "kind").agg(F.sum("_one").alias("records")).select("name", "records", "kind")


# Safety --------------------------------------------------------------------------------------------------------------

def mask_context(c: Column) -> Column:
    """Harmless phrases blanked out before the rules look."""
    s = F.coalesce(c, F.lit(""))
    for pattern in fixed.SAFETY_MASKS:
        s = tx.replace_all(s, pattern, " ", True)
    return s


def safety_matches(masked: Column, rules: Sequence[tuple[str, str, str]] = fixed.SAFETY_RULES) -> Column:
    """PR07. Array of (id, category, snippet) of every rule that matches a text without its harmless phrases."""
    hits = []
    for rid, category, pattern in rules:
        m = F.regexp_extract(masked, tx.ascii_regex(pattern, True), 0)
        hits.append(F.when(m != "", F.struct(F.lit(rid).alias("id"), F.lit(category).alias("category"), m.alias("snippet"))))
    return F.array_compact(F.array(*hits))


def safety_classify(df: DataFrame, text: str) -> DataFrame:
    """PR07. Matches per row; the masked text is computed once in its own projection."""
    d = df.withColumn("_t", mask_context(F.col(text))).withColumn("matches", safety_matches(F.col("_t"))).drop("_t")
    return d.withColumn("matched", F.size("matches") > 0)


def conversation_sweep(messages: DataFrame, tagged: DataFrame, customer_roles: Sequence[str] = ("user", "lead", "contact")) -> DataFrame:
    """PR08. First matching customer message of every conversation that is not tagged yet.

    Only rows that match go on, and the first is found by an aggregate, so a long conversation stays spread out.
    """
    m = messages.filter(F.col("role").isin(*customer_roles)).withColumn("_body", strip_html(F.col("text")))
    hit = safety_classify(m.select("conv_id", "turn", "_body"), "_body").filter("matched").join(tagged.select("conv_id"), "conv_id", "left_anti")
    g = hit.groupBy("conv_id").agg(F.min_by(F.struct("turn", "matches", "_body"), "turn").alias("f"))
    return g.select("conv_id", F.col("f.turn").alias("turn"), F.array_join(F.transform("f.matches", lambda x: x["id"]), ",").alias("rules"), tx.snippet(F.col("f._body")).alias("snippet"))


def share_downgrade(rows: DataFrame, agents: Sequence[str], words: Sequence[str]) -> DataFrame:
    """PR09. The share flag is taken back on denied rows."""
    bad = denied(F.col("agent"), [F.col("text")], agents, words)
    return rows.withColumn("share", F.col("share") & ~bad)


# Retention and requests ------------------------------------------------------------------------------------------------

def retention_policy(rows: DataFrame, policies: DataFrame, kind: str, trigger: str, now: Column, personal: Sequence[str]) -> DataFrame:
    """PR10. keep, delete, archive_delete or anonymize per row; personal columns of anonymised rows become null."""
    p = policies.select(F.col("data_type").alias("_k"), "retention_days", "archive", "anonymize")
    j = rows.join(p, F.col(kind) == F.col("_k"), "left")
    old = F.coalesce(F.date_add(F.to_date(trigger), F.col("retention_days")) < F.to_date(now), F.lit(False))
    act = F.when(~old, "keep").when(F.col("anonymize"), "anonymize").when(F.col("archive"), "archive_delete").otherwise("delete")
    j = j.withColumn("action", act)
    gone = F.col("action") == "anonymize"
    cols = [F.when(~gone, F.col(c)).alias(c) if c in personal else F.col(c) for c in rows.columns]
    return j.select(*cols, "action", gone.alias("anonymized"))


def subject_access(sources: dict[str, tuple[DataFrame, str]], subject) -> DataFrame:
    """PR11. Every row of one subject from several tables in one envelope (source, payload)."""
    out = None
    for name, (df, key) in sources.items():
        part = df.filter(F.col(key) == subject).select(F.lit(name).alias("source"), F.to_json(F.struct(*df.columns)).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def erasure_with_exceptions(sources: dict[str, tuple[DataFrame, str]], subjects: DataFrame, holds: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """PR12. (tables without the erasable rows, report per source of deleted and retained rows).

    ``subjects`` has (subject), ``holds`` has (source, subject, reason); a held subject keeps its rows in that source, with the first of its reasons.
    """
    kept, report = {}, None
    for name, (df, key) in sources.items():
        h = holds.filter(F.col("source") == name).groupBy(F.col("subject").alias("_h")).agg(F.min("reason").alias("reason"))
        want = subjects.select(F.col("subject").alias("_s")).distinct().join(h, F.col("_s") == F.col("_h"), "left")
        go = want.filter("_h IS NULL")
        kept[name] = df.join(go, F.col(key) == F.col("_s"), "left_anti")
        r = df.join(want, F.col(key) == F.col("_s")).groupBy(F.when(F.col("_h").isNull(), "deleted").otherwise(F.concat(F.lit("retained: "), "reason")).alias("result")).agg(
            F.count("*").alias("rows")).withColumn("source", F.lit(name))
        report = r if report is None else report.unionByName(r)
    return kept, report


def purpose_columns(df: DataFrame, allowed: dict[str, Sequence[str]], purpose: str) -> DataFrame:
    """PR13. Only the columns allowed for the purpose; an unknown purpose is refused."""
    if purpose not in allowed:
        raise ValueError(f"no columns are allowed for purpose {purpose!r}")
    return df.select(*[c for c in df.columns if c in allowed[purpose]])


PROHIBITED = ["cvv", "cvv2", "cvc", "pin"]


def mask_card(df: DataFrame, card: str) -> DataFrame:
    """PR14. First six and last four digits stay; prohibited fields are dropped."""
    c, n = F.col(card), F.length(card)
    masked = F.concat(F.substring(c, 1, 6), F.repeat(F.lit("*"), F.greatest(n - 10, F.lit(0))), F.right(c, F.lit(4)))
    return df.drop(*[x for x in df.columns if x.lower() in PROHIBITED]).withColumn(card, masked)


def prohibited_fields(df: DataFrame) -> list[str]:
    """PR14. Names of fields that must not be stored."""
    return [c for c in df.columns if c.lower() in PROHIBITED]


def luhn_valid(c: Column) -> Column:
    """PR15. Luhn checksum of the digits; blanks and dashes are ignored, anything else fails."""
    digits = F.regexp_replace(c, r"[\s-]", "")
    ok = digits.rlike("^[0-9]+$")
    d = F.transform(F.split(F.reverse(F.when(ok, digits).otherwise("1")), "(?!$)"), lambda x: x.cast("int"))
    v = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return F.coalesce(ok & (F.aggregate(v, F.lit(0), lambda a, x: a + x) % 10 == 0), F.lit(False))


SENSITIVE_TYPES = ["health", "financial", "credentials", "biometric"]


def notification_required(df: DataFrame, severity: str, types: str) -> DataFrame:
    """PR16. Sensitive data or a severity from medium up."""
    s = F.array(*[F.lit(x) for x in SENSITIVE_TYPES])
    return df.withColumn("notify", F.arrays_overlap(types, s) | F.col(severity).isin("medium", "high", "critical"))


