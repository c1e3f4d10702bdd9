"""Places in location texts: a gazetteer of names, codes and parents, compiled to column expressions without a join.

A gazetteer is configuration of bounded size. It stands in the plan as constants; texts are read in one pass: codes after
commas, then the longest names from left to right, then everything that lies above what was found.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.clean import let, no
from ..functions.matching import keyword_match, words_of
from ..functions.text import normalize_text

# fixed values: countries with their names and codes
COUNTRIES = {
    "united states": (("united states", "united states of america", "usa", "us", "u s", "u s a"), ("US", "USA")),
    "united kingdom": (("united kingdom", "uk", "u k", "great britain", "britain", "gb"), ("GB", "UK", "GBR")),
    "canada": (("canada",), ("CA", "CAN")),
    "australia": (("australia",), ("AU", "AUS")),
    "new zealand": (("new zealand",), ("NZ", "NZL")),
    "ireland": (("ireland", "republic of ireland", "eire"), ("IE", "IRL")),
    "germany": (("germany", "deutschland"), ("DE", "DEU")),
    "france": (("france",), ("FR", "FRA")),
    "netherlands": (("netherlands", "the netherlands", "holland"), ("NL", "NLD")),
    "belgium": (("belgium",), ("BE", "BEL")),
    "luxembourg": (("luxembourg",), ("LU", "LUX")),
    "spain": (("spain", "espana"), ("ES", "ESP")),
    "portugal": (("portugal",), ("PT", "PRT")),
    "italy": (("italy", "italia"), ("IT", "ITA")),
    "switzerland": (("switzerland", "schweiz", "suisse"), ("CH", "CHE")),
    "austria": (("austria", "osterreich"), ("AT", "AUT")),
    "sweden": (("sweden",), ("SE", "SWE")),
    "norway": (("norway",), ("NO", "NOR")),
    "denmark": (("denmark",), ("DK", "DNK")),
    "finland": (("finland",), ("FI", "FIN")),
    "iceland": (("iceland",), ("IS", "ISL")),
    "poland": (("poland",), ("PL", "POL")),
    "india": (("india",), ("IN", "IND")),
    "singapore": (("singapore",), ("SG", "SGP")),
    "united arab emirates": (("united arab emirates", "uae"), ("AE", "ARE")),
    "israel": (("israel",), ("IL", "ISR")),
    "japan": (("japan",), ("JP", "JPN")),
    "south africa": (("south africa",), ("ZA", "ZAF")),
    "brazil": (("brazil", "brasil"), ("BR", "BRA")),
    "mexico": (("mexico",), ("MX", "MEX")),
    "hong kong": (("hong kong",), ("HK", "HKG")),
    "philippines": (("philippines",), ("PH", "PHL")),
}
# fixed values: states of the United States by code
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois",
    "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana",
    "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york", "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania",
    "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
    "DC": "district of columbia",
}
# fixed values: other parts of countries (those that hold the name of another place keep it from being read)
PARTS = {
    "united kingdom": ("england", "scotland", "wales", "northern ireland"),
    "united states": ("new england", "washington dc"),
    "canada": ("british columbia", "alberta", "saskatchewan", "manitoba", "quebec", "nova scotia", "newfoundland", "newfoundland and labrador", "prince edward island", "yukon", "northwest territories", "nunavut"),
    "australia": ("new south wales", "queensland", "tasmania", "western australia", "south australia", "northern territory", "australian capital territory"),
    "india": ("maharashtra", "karnataka", "tamil nadu", "telangana", "gujarat", "uttar pradesh", "west bengal", "kerala", "haryana", "rajasthan", "andhra pradesh"),
    "germany": ("bavaria", "bayern", "baden wurttemberg", "baden wuerttemberg", "north rhine westphalia", "nordrhein westfalen", "hesse", "hessen", "lower saxony", "niedersachsen", "saxony"),
}
# fixed values: regions with their names and countries
REGIONS = {
    "europe": (("europe", "eu", "european union"), ("united kingdom", "ireland", "germany", "france", "netherlands", "belgium", "luxembourg", "spain", "portugal", "italy", "switzerland", "austria", "sweden", "norway", "denmark", "finland", "iceland", "poland")),
    "north america": (("north america",), ("united states", "canada", "mexico")),
    "dach": (("dach",), ("germany", "austria", "switzerland")),
    "nordics": (("nordics", "nordic", "scandinavia"), ("sweden", "norway", "denmark", "finland", "iceland")),
    "benelux": (("benelux",), ("belgium", "netherlands", "luxembourg")),
    "anz": (("anz",), ("australia", "new zealand")),
}
# fixed values: words that say nothing about where
PLACELESS = (
    "remote", "anywhere", "worldwide", "global", "globally", "hybrid", "onsite", "on", "site", "office", "in", "or", "and", "from", "home", "wfh", "work", "based", "flexible",
    "multiple", "various", "several", "locations", "location", "n", "a", "tbd", "tbc", "unknown", "none", "not", "specified", "other",
)


def constant(value: dict, kind: str) -> Column:
    """A map as one literal, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), f"map<string,{kind}>")


@dataclass
class Gazetteer:
    """names: place by normalised name; codes: country by code; states: state of the home country by two-letter code;
    parents: what lies directly above a place."""

    names: dict[str, str]
    codes: dict[str, str]
    states: dict[str, str]
    parents: dict[str, set[str]]
    countries: set[str]
    regions: set[str]
    home: str = "united states"
    above: dict[str, list[str]] = field(init=False)

    def __post_init__(self) -> None:
        places = {*self.names.values(), *self.codes.values(), *self.states.values(), *self.parents}
        self.above = {p: sorted(self.closure({p})) for p in places}

    @classmethod
    def default(cls) -> Gazetteer:
        names, codes, parents = {}, {}, {}
        for place, (aliases, cs) in COUNTRIES.items():
            names |= {" ".join(words_of(a)): place for a in aliases}
            codes |= dict.fromkeys(cs, place)
        for country, parts in [*PARTS.items(), ("united states", tuple(STATES.values()))]:
            for part in parts:
                names[part] = part
                parents.setdefault(part, set()).add(country)
        for region, (aliases, members) in REGIONS.items():
            names |= dict.fromkeys(aliases, region)
            for m in members:
                parents.setdefault(m, set()).add(region)
        return cls(names, codes, dict(STATES), parents, set(COUNTRIES), set(REGIONS))

    def closure(self, places: set[str]) -> set[str]:
        out, todo = set(places), list(places)
        while todo:
            new = self.parents.get(todo.pop(), set()) - out
            out |= new
            todo += new
        return out

    @cached_property
    def longest(self) -> int:
        return max(len(n.split()) for n in self.names)

    def place_of(self, criterion: str) -> str | None:
        """The place that a configured location means, by name or code; None if it is matched as a phrase."""
        if (found := self.names.get(" ".join(words_of(criterion)))) is not None:
            return found
        code = re.sub(r"[\s.]", "", criterion).upper()
        return self.states.get(code) or self.codes.get(code)

    def named(self, text: Column) -> Column:
        """Places whose names stand in a text, the longest names first from left to right."""
        names, none = constant(self.names, "string"), F.array().cast("array<string>")

        def read(w: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                sizes = [F.when(i + size <= F.size(w), F.try_element_at(names, F.array_join(F.slice(w, i + 1, size), " "))) for size in range(self.longest, 0, -1)]
                hits = F.array(*(F.struct(hit.alias("place"), F.lit(size).alias("size")) for hit, size in zip(sizes, range(self.longest, 0, -1), strict=True)))
                hit = F.get(F.filter(hits, lambda h: h["place"].isNotNull()), F.lit(0))
                found = let(hit, lambda h: F.when(h.isNull(), state).otherwise(F.struct((i + h["size"]).alias("free"), F.concat(state["ids"], F.array(h["place"])).alias("ids"))))
                return F.when(i < state["free"], state).otherwise(found)

            start = F.struct(F.lit(0).alias("free"), none.alias("ids"))
            places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(places, start, step, lambda s: s["ids"])

        return let(F.filter(F.split(normalize_text(text), " "), lambda x: x != ""), read)

    def with_parents(self, ids: Column) -> Column:
        above = constant(self.above, "array<string>")
        return F.array_distinct(F.flatten(F.transform(ids, lambda p: F.coalesce(F.try_element_at(above, p), F.array(p)))))

    def ids(self, text: Column, country_field: bool = False, hint: Column | None = None) -> Column:
        """Places in a text with all above them; empty for null. A hint (a country, or empty) decides codes that are both
        a state's and a country's; without one other places in the text do, then the part before, else it is the state."""
        codes, states = constant(self.codes, "string"), constant(self.states, "string")
        both = "|".join(c for c in self.states if c in self.codes)
        known = F.struct(F.btrim(no(text)).alias("s"), no(hint if hint is not None else F.lit(None).cast("string")).alias("hint"))

        def read(k: Column) -> Column:
            s = k["s"]
            compact = F.upper(F.regexp_replace(s, r"[\s.]", ""))
            after = F.regexp_extract_all(s, F.lit(r",\s*([A-Z]{2})(?![A-Za-z])"), F.lit(1))
            alone = s.rlike("^[A-Z]{2}$") & F.map_contains_key(states, s)
            by_field = F.try_element_at(codes, compact) if country_field else F.lit(None).cast("string")
            plain = F.filter(after, lambda c: ~c.rlike(f"^(?:{both})$"))
            sure = F.transform(plain, lambda c: F.coalesce(F.try_element_at(states, c), F.try_element_at(codes, c)))
            open_alone = alone & by_field.isNull() & s.rlike(f"^(?:{both})$") & (k["hint"] != "")
            first = F.coalesce(by_field, F.when(alone & ~open_alone, F.try_element_at(states, s)))
            found = F.filter(F.concat(F.array(first), sure, self.named(s)), lambda p: p.isNotNull())
            asked = F.concat(F.filter(after, lambda c: c.rlike(f"^(?:{both})$")), F.when(open_alone, F.array(s)).otherwise(F.array().cast("array<string>")))
            return F.struct(s.alias("s"), k["hint"].alias("hint"), found.alias("found"), asked.alias("asked"), F.regexp_extract(s, r",\s*([A-Z]{2})[ .]*$", 1).alias("last"))

        def decided(r: Column) -> Column:
            def one(code: Column, at: Column, state: Column, iso: Column) -> Column:
                inside = F.filter(at, lambda p: p.isin(*sorted(self.countries)))
                regions = F.filter(at, lambda p: p.isin(*sorted(self.regions)))
                of = lambda p: F.coalesce(F.try_element_at(constant(self.above, "array<string>"), p), F.array(p))
                parts = F.transform(F.split(r["s"], ","), lambda x: F.btrim(x))
                before = F.get(parts, F.size(parts) - 2)
                ours = F.map_contains_key(states, F.upper(before)) | F.array_contains(F.array(*(F.lit(p) for p in sorted(self.parents.keys() - self.countries))), normalize_text(before)) | before.rlike(r"(?i)\b(?:county|parish|borough)\b")
                foreign = (F.size(parts) >= 3) & (r["last"] == code) & (before != "") & ~F.coalesce(ours, F.lit(False))
                return (
                    F.when(r["hint"] == self.home, state).when(r["hint"] != "", F.when(iso == r["hint"], iso))
                    .when((F.size(inside) == 1) & F.array_contains(inside, self.home), state).when(F.size(inside) > 0, F.when(F.array_contains(inside, iso), iso))
                    .when(F.arrays_overlap(regions, of(iso)) & ~F.arrays_overlap(regions, of(state)), iso).when(foreign, iso).otherwise(state)
                )

            more = let(self.with_parents(r["found"]), lambda at: F.transform(r["asked"], lambda c: one(c, at, F.try_element_at(states, c), F.try_element_at(codes, c))))
            return self.with_parents(F.concat(r["found"], F.filter(F.when(F.size(r["asked"]) > 0, more).otherwise(F.array().cast("array<string>")), lambda p: p.isNotNull())))

        return let(let(known, read), decided)

    def is_placeless(self, text: Column, country_field: bool = False) -> Column:
        """Empty, or only words like Remote that name no place."""
        words = F.filter(F.split(normalize_text(text), " "), lambda x: x != "")
        return let(words, lambda w: (F.size(w) == 0) | (F.forall(w, lambda x: x.rlike(f"^(?:{'|'.join(PLACELESS)})$")) & (F.size(self.ids(text, country_field)) == 0)))

    def country_of(self, country: Column) -> Column:
        """The one country that a country field names, else empty."""
        return let(F.filter(self.ids(country, True), lambda p: p.isin(*sorted(self.countries))), lambda c: no(F.when(F.size(c) == 1, F.get(c, F.lit(0)))))

    def match(self, criteria: Sequence[str], text: Column, country_field: bool = False, hint: Column | None = None) -> Column:
        """The first configured location that the text lies in, as written; null if none."""

        def first(ids: Column) -> Column:
            hits = [F.when(F.array_contains(ids, place), F.lit(c)) if (place := self.place_of(c)) is not None else keyword_match(text, [c]) for c in criteria]
            return F.coalesce(*hits) if hits else F.lit(None).cast("string")

        return let(self.ids(text, country_field, hint), first)


def shown(items: Sequence[str], n: int = 5) -> str:
    return ", ".join(items[:n]) + (f", +{len(items) - n} more" if len(items) > n else "")


def location_fit(location: Column, country: Column, signal_places: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), gazetteer: Gazetteer | None = None) -> Column:
    """struct(status, reason): whether a company lies where it should; null status if its place is unknown.

    A company's own places come before those of its signals (an array of texts); those only exclude it if there is no
    other and all are excluded. The country field decides codes in the location.
    """
    g = gazetteer or Gazetteer.default()
    answer = lambda status, reason: F.struct(F.lit(status).cast("boolean").alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    if not include and not exclude:
        return answer(True, "")
    places = F.array_distinct(F.filter(F.coalesce(signal_places, F.array().cast("array<string>")), lambda x: ~F.coalesce(g.is_placeless(x), F.lit(True))))
    known = F.struct(
        F.when(~g.is_placeless(location), location).alias("location"), F.when(~g.is_placeless(country, True), country).alias("country"), g.country_of(country).alias("hint"), places.alias("places"),
    )

    def hits(k: Column, criteria: Sequence[str]) -> Column:
        """What each known place meets, own ones first."""
        home = F.array(
            F.struct(k["location"].alias("text"), g.match(criteria, k["location"], hint=k["hint"]).alias("hit"), F.lit(True).alias("home")),
            F.struct(k["country"].alias("text"), g.match(criteria, k["country"], True).alias("hit"), F.lit(True).alias("home")),
        )
        return F.filter(F.concat(home, F.transform(k["places"], lambda p: F.struct(p.alias("text"), g.match(criteria, p).alias("hit"), F.lit(False).alias("home")))), lambda h: h["text"].isNotNull())

    def decided(k: Column) -> Column:
        out = F.when(k["location"].isNull() & k["country"].isNull() & (F.size(k["places"]) == 0), answer(None, "location unknown"))
        if exclude:
            def excluded(all_: Column) -> Column:
                own = F.get(F.filter(all_, lambda h: h["home"] & h["hit"].isNotNull()), F.lit(0))
                only = ~F.exists(all_, lambda h: h["home"]) & F.forall(all_, lambda h: h["hit"].isNotNull())
                where = F.array_join(F.slice(F.transform(all_, lambda h: h["text"]), 1, 3), ", ")
                quoted = lambda x: F.concat(F.lit("excluded location '"), x, F.lit("' ("))
                return F.when(own.isNotNull(), F.concat(quoted(own["hit"]), own["text"], F.lit(")"))).when(only, F.concat(quoted(F.get(all_, F.lit(0))["hit"]), F.lit("signals in "), where, F.lit(")")))

            bad = let(hits(k, exclude), excluded)
            out = out.when(bad.isNotNull(), answer(False, bad))
        if not include:
            return out.otherwise(answer(True, "location not excluded"))

        def included(all_: Column) -> Column:
            hit = F.get(F.filter(F.transform(all_, lambda h: h["hit"]), lambda x: x.isNotNull()), F.lit(0))
            got = F.concat(F.lit(f"location not in ICP [{shown(include)}] (got: "), F.array_join(F.slice(F.transform(all_, lambda h: h["text"]), 1, 3), "; "), F.lit(")"))
            return F.when(hit.isNotNull(), answer(True, F.concat(F.lit("location match ("), hit, F.lit(")")))).otherwise(answer(False, got))

        return out.otherwise(let(hits(k, include), included))

    return let(known, decided)
