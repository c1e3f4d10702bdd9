"""Records of any columns to companies with their signals and people, by a mapping that is compiled into one select.

A mapping gives each canonical field the columns or dotted paths that hold it (the first that is not blank counts). Paths
lead through structs, maps, lists and VARIANT values. What a record yields is an expression over these, so Spark reads
only the columns that are mapped, in one pass and without Python.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import as_text, clean_domain, clean_email, clean_text, clean_url, domain_matches_name, email_status, first_of, is_free_email, let, name_parts, no, once, website_parts
from ..functions.dates import parse_when
from ..functions.text import amount_currency, format_money, is_blank, normalize_text, parse_amount, stage_words, to_int
from ..operators.components import spread
from . import headers
from .headers import PERSON, normal_mapping, paths

SIGNAL_TYPE = "struct<type:string,title:string,source:string,posted_at:date,url:string,location:string,description:string,external_id:string,data:map<string,string>>"
CONTACT_TYPE = "struct<first_name:string,last_name:string,full_name:string,title:string,email:string,email_status:string,linkedin_url:string,phone:string,seniority:string,department:string,location:string,source:string,data:map<string,string>>"
# fixed values: where the fields of people in a list stand by default
PEOPLE = {"first_name": "first_name", "last_name": "last_name", "full_name": ["full_name", "name"], "title": ["title", "role", "job_title"], "email": "email", "email_status": "email_status", "person_linkedin_url": ["linkedin_url", "linkedin"], "phone": "phone", "seniority": "seniority", "department": "department", "person_location": "location"}


@dataclass
class Value:
    """A value of a record and its type."""

    column: Column
    kind: T.DataType

    def member(self, name: str) -> Value | None:
        """The struct field, map value, list item or VARIANT member of this name."""
        kind = self.kind
        if isinstance(kind, T.StructType):
            found = next((f for f in kind.fields if f.name == name), None)
            return found and Value(self.column.getField(f"{name}"), found.dataType)
        if isinstance(kind, T.MapType):
            return Value(F.try_element_at(self.column, F.lit(name)), kind.valueType)
        if isinstance(kind, T.ArrayType) and name.lstrip("-").isdigit():
            at = int(name)
            return Value(F.try_element_at(self.column, F.lit(at + 1 if at >= 0 else at)), kind.elementType)
        if isinstance(kind, T.VariantType):
            step = f"$[{name}]" if name.isdigit() else "$['" + name.replace("'", "\\'") + "']"
            return Value(F.try_variant_get(self.column, step, "variant"), kind)
        return None

    def text(self) -> Column:
        return as_text(self.column, self.kind)

    def parts(self) -> Column | None:
        """The items of a list as texts; null for what is no list."""
        if isinstance(self.kind, T.ArrayType):
            return F.transform(self.column, lambda x: as_text(x, self.kind.elementType))
        if isinstance(self.kind, T.VariantType):
            return F.transform(F.try_variant_get(self.column, "$", "array<variant>"), lambda x: as_text(x, self.kind))
        return None


class Record:
    """Access to a record's values by path: a name as it stands comes before a path through names."""

    def __init__(self, columns: Mapping[str, Value], root: Value | None = None):
        self.columns, self.root = columns, root

    @classmethod
    def of(cls, df: DataFrame, root: str | None = None) -> Record:
        """Records of the rows of df, or of the values of its column root."""
        if root is not None:
            return cls({}, Value(F.col(f"`{root}`"), df.schema[root].dataType))
        return cls({f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields})

    def find(self, path: str) -> Value | None:
        if path in self.columns:
            return self.columns[path]
        whole = self.root.member(path) if self.root else None
        steps = path.replace("[", ".").replace("]", "").split(".")
        if len(steps) == 1:
            return whole
        at = self.columns.get(steps[0]) or (self.root.member(steps[0]) if self.root else None)
        for step in steps[1:]:
            at = at and at.member(step)
        if whole is None or at is None or not isinstance(self.root.kind, (T.VariantType, T.MapType)):
            return whole or at
        return Value(F.coalesce(whole.column, at.column), at.kind)

    def text(self, names: Sequence[str]) -> Column:
        """The first text of these paths that is not blank."""
        found = [v.text() for v in map(self.find, names) if v is not None]
        return first_of(*found) if found else F.lit("")

    def parts(self, names: Sequence[str]) -> Column:
        """Items of the first path that is not blank: of a list its items, of a text those between , ; | and line ends."""
        out = []
        for v in filter(None, map(self.find, names)):
            text = v.text()
            cut = F.transform(F.split(clean_text(F.regexp_replace(text, r"[\r\n]", ",")), "[,;|]"), lambda x: F.btrim(x))
            lists = v.parts()
            items = cut if lists is None else F.coalesce(F.transform(lists, lambda x: clean_text(x)), cut)
            out.append(F.when(text != "", items))
        return F.coalesce(*out, F.array().cast("array<string>")) if out else F.array().cast("array<string>")


def template(pattern: str, record: Record, extra: Mapping[str, Column], need_value: bool = True) -> Column:
    """"Rated {totalScore} with {reviewsCount} reviews" over a record; blank values are left out, with empty brackets and
    blanks before marks. Empty if no field has a value (and need_value). {x:.1f} rounds numbers. A ValueError for
    patterns that do not parse."""
    out, values = [], []
    for text, name, spec, _ in string.Formatter().parse(pattern):
        out.append(F.lit(text))
        if name is not None:
            value = record.text([name])
            if name in extra:
                value = first_of(value, extra[name])
            values.append(value != "")
            if spec and spec.lstrip(",").startswith(".") and spec.endswith("f"):
                number = value.try_cast("double")
                value = F.when(number.isNotNull(), F.format_string(f"%{spec}", number)).otherwise(value)
            out.append(value)
    joined = F.concat(*out) if out else F.lit("")
    if values:
        tidy = F.regexp_replace(F.regexp_replace(joined, r"\(\s*\)|\[\s*\]", ""), r"\s+([)\].,;:!?])", "$1")
        joined = F.when(F.array_contains(F.array(*values), True) | F.lit(not need_value), tidy).otherwise("")
    return F.btrim(F.regexp_replace(joined, r"(?U)\s+", " "))


def ordered_once(items: Column, key) -> Column:
    """Items of a short list, of each key the first."""
    return let(items, lambda held: let(F.transform(held, key), lambda keys: F.filter(held, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def text_map(pairs: Sequence[tuple[str, Column]]) -> Column:
    """A map of what is not empty."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs))), lambda k, v: v != "")


def contact_key(c: Column) -> Column:
    return first_of(c["email"], F.regexp_replace(F.lower(c["linkedin_url"]), "/+$", ""), normalize_text(c["full_name"]))


def signal_key(s: Column) -> Column:
    return F.concat_ws("\u0001", s["type"], normalize_text(s["title"]), s["external_id"])


@dataclass
class Mapper:
    """A mapping with what belongs to it.

    label: the source's name in everything made. defaults: constants for fields that a record leaves blank. title: a
    template for signals without a title. requires: paths that must not be blank for a record's own signal. default_signal:
    {type, title, description, url, date} for records without a signal of their own. people: {path, mapping} of a list of
    people in each record. date_order: "mdy" or "dmy"; without it dates are read as most of the table's dates allow.
    """

    mapping: Mapping[str, object]
    label: str
    as_of: Column
    defaults: Mapping[str, object] = field(default_factory=dict)
    title: str = ""
    requires: Sequence[str] = ()
    default_signal: Mapping[str, str] | None = None
    people: Mapping[str, object] | None = None
    location_from_signal: bool = True
    date_order: str | None = None

    def __post_init__(self) -> None:
        self.fields = normal_mapping(self.mapping)
        self.constants = {headers.canonical(k): v for k, v in self.defaults.items() if v is not None and str(v).strip()}
        self.person_paths, self.person_fields = None, {}
        if self.people:
            self.person_paths = str(self.people["path"])
            self.person_fields = {k: paths(v) for k, v in PEOPLE.items()} | normal_mapping(self.people.get("mapping"), people=True)
            wrong = [k for k in self.person_fields if k not in PERSON and not k.startswith("person_data.")]
            if wrong:
                raise ValueError(f"only fields of people in a list of people, not {wrong}")
        if self.default_signal is not None and not self.default_signal.get("title"):
            raise ValueError("a default signal needs a title")

    def order_of(self, df: DataFrame, root: str | None) -> str:
        """The order of day and month in the dates of the mapped columns: one aggregate over the table, dmy on a draw."""
        record = Record.of(df, root)
        dates = [v.text() for f in ("signal_date", "funding_date") for v in map(record.find, self.fields.get(f, ())) if v is not None]
        if not dates:
            return "dmy"
        pattern = r"^(?:(?i)(?:posted|active|updated|published|reposted|listed|added)\s*:?\s*(?:on\s+)?)?([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}(?:[ T,]|$)"
        day = F.explode(F.array(*dates)).alias("day")
        first, second = (F.regexp_extract("day", pattern, k).try_cast("int") for k in (1, 2))
        row = df.select(day).agg(F.count_if((first > 12) & (second <= 12)), F.count_if((second > 12) & (first <= 12))).first()
        return "mdy" if row[1] > row[0] else "dmy"

    def value(self, record: Record, name: str) -> Column:
        constant = self.constants.get(name)
        found = record.text(self.fields.get(name, ()))
        return found if constant is None else first_of(found, F.lit(str(constant)))

    def extras(self, record: Record, prefix: str, fields: Mapping[str, list[str]] | None = None) -> list[tuple[str, Column]]:
        return [(f[len(prefix) :], record.text(p)) for f, p in (fields or self.fields).items() if f.startswith(prefix)]

    def given(self, record: Record, fields: Mapping[str, Sequence[str]] | None = None) -> set[str]:
        """Fields that a path of the record or a constant may fill. The others are empty in every row, which is known
        before any is read: nothing is planned or computed for them."""
        found = {f for f, names in (fields or self.fields).items() if any(record.find(n) is not None for n in names)}
        return found if fields else found | set(self.constants)

    def contact(self, val, data: list[tuple[str, Column]], given: set[str]) -> Column | None:
        """A contact struct; null without a name, an address and a profile. None if none of these is given."""
        if not given & {"first_name", "last_name", "full_name", "email", "person_linkedin_url"}:
            return None
        f = lambda n, limit=0: clean_text(val(n), limit) if n in given else F.lit("")
        spots = [f(n) for n in ("person_city", "person_state", "person_country") if n in given]
        place = first_of(f("person_location", 200), F.array_join(once(F.array(*spots)), ", ")) if spots else f("person_location", 200)
        known = F.struct(
            f("first_name", 100).alias("first"), f("last_name", 100).alias("last"), f("full_name", 200).alias("full"), f("title", 300).alias("title"), (clean_email(val("email")) if "email" in given else F.lit("")).alias("email"),
            (clean_url(val("person_linkedin_url")) if "person_linkedin_url" in given else F.lit("")).alias("page"), val("email_status").alias("status"),
            val("phone").alias("phone"), f("seniority", 100).alias("seniority"), f("department", 200).alias("department"), place.alias("location"), text_map(data).alias("data"),
        )

        def made(s: Column, name: Column) -> Column:
            whole = F.btrim(F.concat_ws(" ", name["first"], name["last"]))
            raw = F.when((s["email"] != "") & (s["status"] != "") & ~F.map_contains_key(s["data"], "email_status_raw"), F.create_map(F.lit("email_status_raw"), s["status"])).otherwise(F.create_map().cast("map<string,string>"))
            out = F.struct(
                name["first"].alias("first_name"), name["last"].alias("last_name"), first_of(s["full"], whole).alias("full_name"), s["title"].alias("title"), s["email"].alias("email"),
                F.when(s["email"] != "", email_status(s["status"])).otherwise("unknown").alias("email_status"), s["page"].alias("linkedin_url"), s["phone"].alias("phone"), s["seniority"].alias("seniority"),
                s["department"].alias("department"), s["location"].alias("location"), F.lit(self.label).alias("source"), F.map_concat(s["data"], raw).alias("data"),
            )
            return F.when((s["full"] != "") | (whole != "") | (s["email"] != "") | (s["page"] != ""), out).cast(CONTACT_TYPE)

        return let(known, lambda s: let(name_parts(s["first"], s["last"], s["full"]), lambda name: made(s, name)))

    def people_of(self, record: Record) -> Column:
        none = F.array().cast(f"array<{CONTACT_TYPE}>")
        items = record.find(self.person_paths) if self.person_paths else None
        if items is None:
            return none
        if isinstance(items.kind, T.VariantType):
            one = F.when(F.schema_of_variant(items.column).startswith("OBJECT"), F.array(items.column))
            items = Value(F.coalesce(F.try_variant_get(items.column, "$", "array<variant>"), one), T.ArrayType(T.VariantType()))
        elif not isinstance(items.kind, T.ArrayType):
            items = Value(F.array(items.column), T.ArrayType(items.kind))

        def made(x: Column) -> Column:
            person = Record({}, Value(x, items.kind.elementType))
            found = self.contact(lambda f: person.text(self.person_fields.get(f, ())), self.extras(person, "person_data.", self.person_fields), self.given(person, self.person_fields))
            return F.lit(None).cast(CONTACT_TYPE) if found is None else found

        return F.coalesce(F.filter(F.transform(items.column, made), lambda c: c.isNotNull()), none)

    def companies(self, df: DataFrame, root: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """df's columns `keep` and, of each record with a name or a host: name, domain, website, linkedin_url, location,
        country, industry, employees, description, keywords, data, signals and contacts.

        Nulls and blank words are as absent fields; a record of repeated columns or rows gives one row each; an empty
        table gives no rows. Names of df that clash with these are read by the mapping only.
        """
        record, order = Record.of(df, root), self.date_order or self.order_of(df, root)
        df = spread(df)
        when = lambda c: parse_when(c, self.as_of, order)
        # each step is a select of its own, so that no value is computed twice: first the texts of the fields
        names = headers.COMPANY + PERSON + headers.SIGNAL + headers.FUNDING
        texts = {n: f"_text{i}" for i, n in enumerate([*names, *(f for f in self.fields if f not in names)])}
        given = self.given(record)
        has = lambda *fs: any(f in given for f in fs)
        val = lambda f: F.col(texts[f]) if f in given else F.lit("")
        made = lambda f, clean, kind="string": clean(val(f)) if f in given else F.lit("" if kind == "string" else None).cast(kind)
        text = lambda f, limit=0: made(f, lambda c: clean_text(c, limit))
        own_extras = lambda prefix: [(f[len(prefix) :], val(f)) for f in self.fields if f.startswith(prefix) and f in given]
        raw = {f"_{f}": text(f, n) for f, n in (("name", 200), ("city", 100), ("state", 100), ("country", 100), ("location", 300), ("industry", 200))}
        raw |= {"_page": made("linkedin_url", clean_url), "_web": website_parts(made("website", clean_url)) if has("website") else F.lit(None), "_host": made("domain", clean_domain), "_about": text("description", 1500), "_employees": made("employees", to_int, "int").cast("int")}
        words = F.slice(F.filter(once(F.col("_parts")), lambda x: ~is_blank(x)), 1, 100)
        raw |= {"_keywords": words if any(record.find(p) is not None for p in self.fields.get("keywords", ())) else F.col("_parts"), "_data": text_map(own_extras("data."))}
        main = self.contact(val, own_extras("person_data."), given)
        raw |= {"_people": F.col("_team") if main is None else F.concat(F.filter(F.array(main), lambda c: c.isNotNull()), F.col("_team"))}
        peopled = main is not None or (self.person_paths is not None and record.find(self.person_paths) is not None)
        needed = F.lit(True)
        for path in self.requires:
            needed = needed & (record.text([path]) != "")
        kind = F.btrim(F.regexp_replace(F.lower(val("signal_type")), "[^a-z0-9]+", "_"), F.lit("_"))
        raw |= {"_needed": F.col("_needs"), "_title": text("signal_title", 300), "_type": F.when(kind == "", "custom").otherwise(kind), "_when": made("signal_date", when, "date"), "_url": made("signal_url", clean_url)}
        raw |= {"_spot": text("signal_location", 200), "_text": text("signal_description", 1500), "_id": val("signal_id"), "_more": text_map(own_extras("signal_data."))}
        raw |= {"_stage": made("funding_stage", lambda _: stage_words(F.col("_round"))), "_raised": made("funding_amount", parse_amount, "double"), "_currency": first_of(val("funding_currency"), F.lit("$")) if has("funding_currency") else F.lit("$"), "_raised_text": val("funding_amount"), "_day": made("funding_date", when, "date"), "_total": made("funding_total", parse_amount, "double"), "_total_text": val("funding_total"), "_news": made("funding_url", clean_url)}
        kept = [F.col(f"`{c}`") for c in keep]
        # what templates and the default signal read from the record
        canon = {k: F.col(f"_{k}") for k in ("name", "city", "state", "country", "location")}
        used = {n: record.text([n]) for t in (self.title, *(str((self.default_signal or {}).get(k, "")) for k in ("title", "description"))) for _, n, _, _ in string.Formatter().parse(t) if n}
        seen = {n: f"_field{i}" for i, n in enumerate(used)}
        first = {texts[n]: self.value(record, n) for n in texts if n in given} | {seen[n]: c for n, c in used.items()}
        first |= {"_parts": record.parts(self.fields.get("keywords", ())), "_team": self.people_of(record), "_needs": needed, "_round": clean_text(self.value(record, "funding_stage")) if has("funding_stage") else F.lit("")}
        rows = df.select(*kept, *(c.alias(n) for n, c in first.items()))
        rows = rows.select(*kept, *seen.values(), *(c.alias(n) for n, c in raw.items()))
        fields = Record({n: Value(F.col(c), T.StringType()) for n, c in seen.items()})

        rows = rows.withColumns({"_own": F.lit(""), "_listing": F.lit("")})
        if has("website"):
            url, domain, foreign, shows = (F.col(f"_web.{c}") for c in ("url", "domain", "foreign", "shows"))
            rows = rows.withColumns({
                "_page": F.when((F.col("_page") == "") & foreign & F.col("_web.linkedin"), url).otherwise(F.col("_page")),
                "_listing": F.when(~foreign & (domain == "") & shows, url).otherwise(""),
                "_own": F.when(domain != "", url).otherwise(""),
                "_host": first_of(F.col("_host"), domain),
            })
        if has("city", "state", "country"):
            rows = rows.withColumn("_location", first_of(F.col("_location"), F.array_join(once(F.array("_city", "_state", "_country")), ", ")))
        # a host of people's addresses stands in if it may be the company's own
        if peopled:
            hosts = F.filter(F.transform("_people", lambda c: F.when((c["email"] != "") & ~is_free_email(c["email"]), clean_domain(c["email"])).otherwise("")), lambda h: h != "")
            rows = rows.withColumn("_hosts", F.when(F.col("_host") == "", hosts).otherwise(F.array().cast("array<string>")))
            fits = F.filter("_hosts", lambda h: (F.col("_name") == "") | domain_matches_name(h, F.col("_name")))
            rows = rows.withColumns({"_host": first_of(F.col("_host"), F.get(fits, F.lit(0))), "_other": F.when(F.size(fits) == 0, no(F.get("_hosts", F.lit(0)))).otherwise("")})
        rows = rows.where("_name <> '' OR _host <> ''").withColumn("_name", F.when(F.col("_name") != "", F.col("_name")).otherwise(F.col("_host")))
        canon["domain"] = F.col("_host")

        title = first_of(F.col("_title"), clean_text(template(self.title, fields, canon), 300) if self.title else F.lit(""))
        signal = F.struct(F.col("_type").alias("type"), title.alias("title"), F.lit(self.label).alias("source"), F.col("_when").alias("posted_at"), F.col("_url").alias("url"), F.col("_spot").alias("location"), F.col("_text").alias("description"), F.col("_id").alias("external_id"), F.col("_more").alias("data"))
        own = F.when(F.col("_needed") & (title != ""), signal).cast(SIGNAL_TYPE)
        rows = rows.withColumn("_own_signal", own)
        signals = ["_own_signal"]
        if self.default_signal is not None:
            signals.append(F.when(F.col("_own_signal").isNull(), self.stand_in(fields, canon, when)).cast(SIGNAL_TYPE))
        if has("funding_stage", "funding_amount", "funding_date"):
            signals.append(self.funding().cast(SIGNAL_TYPE))
        location = F.col("_location")
        if self.location_from_signal and has("signal_location"):
            location = F.when(location == "", no(F.col("_own_signal.location"))).otherwise(location)
        more = [(k, F.col(f"_{c}")) for k, c, there in (("listing_url", "listing", has("website")), ("email_domain", "other", peopled), ("city", "city", has("city")), ("state", "state", has("state"))) if there]
        data = F.map_concat("_data", F.map_filter(text_map(more), lambda k, v: ~F.map_contains_key("_data", k))) if more else F.col("_data")
        return rows.select(
            *kept, F.col("_name").alias("name"), F.col("_host").alias("domain"), F.col("_own").alias("website"), F.col("_page").alias("linkedin_url"), location.alias("location"), F.col("_country").alias("country"), F.col("_industry").alias("industry"),
            F.col("_employees").alias("employees"), F.col("_about").alias("description"), F.col("_keywords").alias("keywords"), data.alias("data"),
            ordered_once(F.filter(F.array(*signals), lambda s: s.isNotNull()), signal_key).alias("signals"), (ordered_once(F.col("_people"), contact_key) if peopled else F.col("_people")).alias("contacts"),
        )

    def stand_in(self, record: Record, canon: Mapping[str, Column], when) -> Column:
        """The default signal; null if there is none or its title is empty."""
        given = self.default_signal
        if given is None:
            return F.lit(None).cast(SIGNAL_TYPE)
        kind = "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in str(given.get("type") or "custom").lower()).split())
        title = clean_text(template(str(given["title"]), record, canon, need_value=False), 300)
        about = clean_text(template(str(given.get("description") or ""), record, canon, need_value=False), 1500)
        made = F.struct(F.lit(kind).alias("type"), title.alias("title"), F.lit(self.label).alias("source"), when(F.lit(given.get("date") or given.get("posted_at")).cast("string")).alias("posted_at"), clean_url(F.lit(str(given.get("url") or ""))).alias("url"), F.lit("").alias("location"), about.alias("description"), F.lit("").alias("external_id"), text_map([]).alias("data"))
        return F.when(title != "", made)

    def funding(self) -> Column:
        """A signal of a funding round; null if nothing is known of one."""
        stage, day, low = F.col("_stage"), F.col("_day"), F.lower("_stage")
        amount, total = (F.nullif(F.col(c), F.lit(0.0)) for c in ("_raised", "_total"))
        money = no(F.when(amount.isNotNull(), format_money(amount, first_of(amount_currency(F.col("_raised_text")), F.col("_currency")))))
        sum_text = format_money(total, first_of(amount_currency(F.col("_total_text")), F.col("_currency")))
        brackets = F.concat(F.lit("Raised "), stage, F.lit(" ("), money, F.lit(")"))
        title = (
            F.when(low.isin("ipo", "public", "went public"), "Went public (IPO)").when(low.startswith("acquired"), stage).when((stage != "") & (money != ""), brackets)
            .when(stage != "", F.concat(F.lit("Raised "), stage)).when(money != "", F.concat(F.lit("Raised "), money)).otherwise("Raised a funding round")
        )
        number = lambda c: no(as_text(c, T.DoubleType()))
        about = no(F.when(total.isNotNull(), F.concat(F.lit("Total funding to date: "), sum_text)))
        made = F.struct(F.lit("funding").alias("type"), title.alias("title"), F.lit(self.label).alias("source"), day.alias("posted_at"), F.col("_news").alias("url"), F.lit("").alias("location"), about.alias("description"), F.lit("").alias("external_id"), text_map([("stage", stage), ("amount", number(amount)), ("total", number(total))]).alias("data"))
        return F.when((stage != "") | (money != "") | day.isNotNull(), made)


def mapped(df: DataFrame, label: str, as_of: Column, overrides: Mapping[str, object] | None = None, root: str | None = None, keep: Sequence[str] = (), **options) -> DataFrame:
    """Companies of a table whose columns are recognised by their headers; overrides name columns or paths themselves."""
    names = [c for c in df.columns if c not in keep]
    found = headers.detected(names)
    defaults = ({"signal_type": found.signal_type} if found.signal_type else {}) | dict(options.pop("defaults", {}))
    mapping = found.mapping | headers.resolved(overrides, names)
    return Mapper(mapping, label, as_of, defaults=defaults, **options).companies(df, root, keep)
