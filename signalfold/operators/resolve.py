"""Entity resolution in order: companies of one domain, else of one name unless their domains differ; people of one
address, else of one profile, else of one name.

What makes rows equal is found by joins: connected components over shared keys. Only the order within a component is
folded by a helper, which reads a component's distinct rows as a stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_generic_email, normalize_company_name, normalize_domain, normalize_text
from .components import components, staged


def streamed(rows: DataFrame, by: str, order: str, fold, schema: str | T.StructType) -> DataFrame:
    """fold(rows of a group as dicts in order) for each group; its dicts are the rows of the result. Groups lie in one
    partition each and pass as a stream."""
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[dict]:
            for b in batches:
                yield from b.to_pylist()

        out: list[dict] = []
        for row in fold(groups()):
            out.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    assert arrow.names == names
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def merge_companies(rows: DataFrame) -> DataFrame:
    """(seq, key): for each row (seq, name, domain) the seq of the record that it joins, in order of seq.

    A domain hit goes before a name hit; a record without a domain takes the first new domain of its name; one name
    with two domains stays two records. Blank and null names and domains link nothing: a row without both is a record of
    its own. Equal pairs of name and domain always join the first of them, so only distinct pairs are linked and folded;
    a task's memory is bounded by the names and domains of one chain.
    """
    rows = rows.select("seq", filled(F.col("name")).alias("name"), filled(F.col("domain")).alias("domain"))
    return with_keys(rows, pair_keys(rows), "seq", "name", "domain").select("seq", "key")


def filled(c: Column) -> Column:
    """Null for a blank text."""
    return F.when(F.trim(c) != "", c)


def pair_keys(rows: DataFrame) -> DataFrame:
    """(name, domain, key): of each pair that is not null in both the seq of the record that rows (seq, name, domain) of it
    join, as merge_companies says."""
    known = rows.where("name IS NOT NULL OR domain IS NOT NULL")
    name, domain = F.when(F.col("name").isNotNull(), F.xxhash64(F.lit("name"), "name")), F.when(F.col("domain").isNotNull(), F.xxhash64(F.lit("domain"), "domain"))
    pairs = staged(known.groupBy("name", "domain").agg(F.min("seq").alias("seq")).select("*", name.alias("a"), domain.alias("b")), "companies")  # equal hashes only join clusters
    roots = components(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    node = F.coalesce("a", "b")
    bound = pairs.join(roots, node == roots["node"], "left").select("seq", "name", "domain", F.coalesce("root", node).alias("cluster"))

    def fold(items: Iterator[dict]) -> Iterator[dict]:
        at_cluster, by_domain, by_name, domain_of = None, {}, {}, {}
        for r in items:
            if r["cluster"] != at_cluster:
                at_cluster, by_domain, by_name, domain_of = r["cluster"], {}, {}, {}
            seq, name, domain = r["seq"], r["name"], r["domain"]
            at = by_domain.get(domain) if domain else None
            if at is None and name in by_name:
                other = by_name[name]
                if not domain or domain_of[other] in (None, domain):
                    at = other
            if at is None:
                at, domain_of[seq] = seq, domain
            elif domain and domain_of[at] is None:
                domain_of[at] = domain
            if domain:
                by_domain.setdefault(domain, at)
            if name:
                by_name.setdefault(name, at)
            yield {"first": seq, "key": at}

    kind = rows.schema["seq"].dataType.simpleString()
    found = streamed(bound, "cluster", "seq", fold, f"first {kind}, key {kind}").join(pairs.select(F.col("seq").alias("first"), "name", "domain"), "first")
    return staged(found.select("name", "domain", "key"), "company-keys")


def with_keys(rows: DataFrame, keys: DataFrame, seq: str, name: str, domain: str) -> DataFrame:
    """rows with `key` of their pair of columns, or their own seq if both are null."""
    keys = keys.select(F.col("name").alias("_pair_name"), F.col("domain").alias("_pair_domain"), "key")
    same = F.col(name).eqNullSafe(F.col("_pair_name")) & F.col(domain).eqNullSafe(F.col("_pair_domain"))
    kind = rows.schema[seq].dataType
    return rows.join(keys, same, "left").withColumn("key", F.coalesce("key", seq).cast(kind)).drop("_pair_name", "_pair_domain")


#: Fields of a company of which the first that is not empty stays.
FILLED = ("name", "domain", "website", "linkedin_url", "location", "country", "industry", "description")


def company_keys(records: DataFrame, seq: str) -> DataFrame:
    """records with `key`, the seq of the record that each joins. Not staged: a reader of few columns moves no others."""
    own = {"_own_name": filled(normalize_company_name(F.col("name"))), "_own_domain": filled(normalize_domain(F.col("domain")))}
    rows = staged(records.withColumns(own), "records")
    keys = pair_keys(rows.select(F.col(seq).alias("seq"), F.col("_own_name").alias("name"), F.col("_own_domain").alias("domain")))
    return with_keys(rows, keys, seq, *own).drop(*own)


def merged_companies(records: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, signals, contacts) of mapped records (sources.mapping's columns and seq, which orders them).

    companies: key, FILLED, employees, keywords, data; of every field the first that is not empty. signals and contacts:
    key, pos and the struct's fields; of signals of equal type, normalised title and external id, and of contacts of
    equal key (address, else profile, else name) the first. All are aggregates that combine before the shuffle, so a
    company with very many records is no single task; only its distinct keywords and data stand in one row.
    """
    rows = company_keys(records, seq)
    order = F.col(seq)
    first = [F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.col(c) != "", order)).alias(c) for c in FILLED]
    firsts = rows.groupBy("key").agg(*first, F.min_by("employees", F.when(F.col("employees").isNotNull(), order)).alias("employees"))
    firsts = firsts.select("key", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in FILLED), "employees")
    words = rows.select("key", seq, F.posexplode("keywords")).groupBy("key", "col").agg(F.min(F.struct(seq, "pos")).alias("at"))
    words = words.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "col"))), lambda x: x["col"]).alias("keywords"))
    data = rows.select("key", seq, F.explode("data").alias("k", "v")).groupBy("key", "k").agg(F.min_by("v", seq).alias("v"))
    data = data.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("data"))
    companies = firsts.join(words, "key", "left").join(data, "key", "left")
    none = F.create_map().cast("map<string,string>")
    companies = companies.withColumns({"keywords": F.coalesce("keywords", F.array().cast("array<string>")), "data": F.coalesce("data", none)})

    def children(name: str, keys: list[Column]) -> DataFrame:
        spread = rows.select("key", seq, F.posexplode(name)).select("key", F.struct(seq, "pos").alias("at"), "col", *(k.alias(f"k{i}") for i, k in enumerate(keys)))
        once = spread.groupBy("key", *(f"k{i}" for i in range(len(keys)))).agg(F.min("at").alias("at"), F.min_by("col", "at").alias("col"))
        return once.select("key", F.col(f"at.{seq}").alias(seq), F.col("at.pos").alias("pos"), "col.*")

    c = F.col("col")
    person = F.coalesce(F.nullif(c["email"], F.lit("")), F.nullif(F.regexp_replace(F.lower(c["linkedin_url"]), "/+$", ""), F.lit("")), normalize_text(c["full_name"]))
    return companies, children("signals", [c["type"], normalize_text(c["title"]), c["external_id"]]), children("contacts", [person])


PLAIN = ("title", "linkedin_url", "full_name", "first_name", "last_name", "phone", "seniority", "department", "location", "source")
PERSON = "company string, seq long, " + ", ".join(f"{c} string" for c in ("email", "email_status", *PLAIN)) + ", confidence double, email_candidates array<string>, data map<string,string>"


class People:
    """The people of one component in order, found by address, profile and name without comparing all."""

    def __init__(self) -> None:
        self.found: list[dict] = []
        self.places: dict[tuple, list[int]] = {}

    @staticmethod
    def keys(p: dict) -> list[tuple]:
        out = [("mail", p["email"])] if p["email"] else []
        if p["_url"]:
            out.append(("url", p["_url"]))
        if p["_name"]:
            out.append(("name", p["_name"], bool(p["email"]), bool(p["_url"])))
        return out

    def first(self, key: tuple) -> int | None:
        """The first person who has this key now."""
        heap = self.places.get(key, [])
        while heap and key not in self.keys(self.found[heap[0]]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def same(self, c: dict) -> int | None:
        mail, url = bool(c["email"]), bool(c["_url"])
        asked = [k for k in self.keys(c) if k[0] != "name"]
        # a name counts where neither both addresses nor both profiles are known
        asked += [("name", c["_name"], m, u) for m in (False, True) for u in (False, True) if c["_name"] and not (mail and m) and not (url and u)]
        return min((at for at in map(self.first, asked) if at is not None), default=None)

    def add(self, c: dict) -> None:
        at = self.same(c)
        if at is None:
            at = len(self.found)
            self.found.append(c)
            old: list[tuple] = []
        else:
            old = self.keys(self.found[at])
            fill(self.found[at], c)
        for key in self.keys(self.found[at]):
            if key not in old:
                heapq.heappush(self.places.setdefault(key, []), at)


def usable(p: dict) -> bool:
    return bool(p["email"]) and p["email_status"] != "invalid" and not p["_generic"]


def fill(one: dict, other: dict) -> None:
    """Empty fields of a person from another row of theirs; an address goes only if it cannot be used and another can."""
    candidates, host = one["email_candidates"], lambda mail: mail.rpartition("@")[2].removeprefix("www.")
    if other["email"] and other["email"] != one["email"]:
        if not one["email"] or (not usable(one) and usable(other)):
            one.update({k: other[k] for k in ("email", "email_status", "_generic")})
        elif usable(other) and host(other["email"]) == host(one["email"]) and other["email"] not in candidates:
            candidates.append(other["email"])
    for name in (*PLAIN, "_url", "_name"):
        if not one[name]:
            one[name] = other[name]
    if one["confidence"] is None:
        one["confidence"] = other["confidence"]
    candidates += [m for m in dict.fromkeys(other["email_candidates"]) if m and m != one["email"] and m not in candidates]
    one["data"] = other["data"] | one["data"]


def merged_people(contacts: DataFrame) -> DataFrame:
    """People of rows of PERSON (company, seq and fields), each company's rows taken in order of seq: rows of one person are
    one row, of the first seq, filled from the others.

    Rows are of one person if their addresses are equal, else if both profiles are, else if their names are and neither
    both addresses nor both profiles are known. Nulls are as empty fields. Rows that are equal in all fields count once,
    at the first. Components over shared addresses, profiles and names of a company are folded each as a stream, so a
    task holds the distinct people of one component.
    """
    text = [c for c in ("email", "email_status", *PLAIN)]
    rows = contacts.select(
        F.coalesce("company", F.lit("")).alias("company"), "seq", *(F.coalesce(F.lower(F.trim(c)) if c == "email" else F.col(c), F.lit("")).alias(c) for c in text), "confidence",
        F.coalesce("email_candidates", F.array().cast("array<string>")).alias("email_candidates"), F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"),
    )
    url = F.replace(F.replace(F.lower(F.regexp_replace(F.trim("linkedin_url"), "/+$", "")), F.lit("http://"), F.lit("https://")), F.lit("://www."), F.lit("://"))
    rows = rows.withColumns({"_url": url, "_name": normalize_text(F.col("full_name")), "_generic": is_generic_email(F.col("email"))})
    content = [c for c in rows.columns if c not in ("seq", "data")]
    entries = F.array_sort(F.map_entries("data"))
    rows = staged(rows.withColumn("_data", entries).groupBy(*content, "_data").agg(F.min("seq").alias("seq")).withColumn("data", F.map_from_entries("_data")).drop("_data"), "people")
    key = lambda kind, c: F.when(F.col(c) != "", F.xxhash64("company", F.lit(kind), c))
    own = F.xxhash64("company", F.lit("row"), "seq", *content[1:3])
    nodes = rows.select(own.alias("own"), F.filter(F.array(key("mail", "email"), key("url", "_url"), key("name", "_name")), lambda k: k.isNotNull()).alias("keys"))
    roots = components(nodes.select(F.col("own").alias("a"), F.explode("keys").alias("b")))
    bound = rows.withColumn("own", own).join(roots, F.col("own") == roots["node"], "left").withColumn("cluster", F.coalesce("root", "own")).drop("own", "node", "root")

    def fold(items: Iterator[dict]) -> Iterator[dict]:
        at, people = None, People()
        for r in items:
            if r["cluster"] != at:
                yield from people.found
                at, people = r["cluster"], People()
            r["data"] = dict(r["data"])
            people.add(r)
        yield from people.found

    def plain(items: Iterator[dict]) -> Iterator[dict]:
        for p in fold(items):
            yield {k: v for k, v in p.items() if k[0] != "_" and k != "cluster"}

    return streamed(bound, "cluster", "seq", plain, PERSON)
