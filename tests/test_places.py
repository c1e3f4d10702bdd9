"""Places in texts and the nine rejection reasons, against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from signalfold.operators import fit
from signalfold.operators.places import COUNTRIES, PLACELESS, STATES, Gazetteer

G = Gazetteer.default()


def words(text):
    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.findall("[a-z0-9]+", folded.lower())


def plain_ids(text, field=False, hint=""):
    s = (text or "").strip()
    found, asked = [], []
    compact = re.sub(r"[\s.]", "", s).upper()
    if field and compact in G.codes:
        found.append(G.codes[compact])
    elif re.fullmatch("[A-Z]{2}", s) and s in STATES:
        if s in G.codes and hint:
            asked.append((s, True))
        else:
            found.append(STATES[s])
    for m in re.finditer(r",\s*([A-Z]{2})(?![A-Za-z])", s):
        code = m[1]
        if code in STATES and code in G.codes:
            asked.append((code, not s[m.end() :].strip(" .")))
        elif code in STATES or code in G.codes:
            found.append(STATES.get(code) or G.codes[code])
    w, i = words(s), 0
    while i < len(w):
        size = next((n for n in range(min(G.longest, len(w) - i), 0, -1) if " ".join(w[i : i + n]) in G.names), 0)
        if size:
            found.append(G.names[" ".join(w[i : i + size])])
        i += size or 1
    at = G.closure(set(found))
    for code, last in asked:
        state, iso = STATES[code], G.codes[code]
        inside, regions = at & set(COUNTRIES), at & G.regions
        parts = [p.strip() for p in s.split(",")]
        before = parts[-2] if len(parts) > 1 else ""
        ours = before.upper() in STATES or " ".join(words(before)) in G.parents.keys() - G.countries or re.search(r"(?i)\b(?:county|parish|borough)\b", before)
        if hint:
            hit = state if hint == "united states" else iso if iso == hint else None
        elif inside:
            hit = state if inside == {"united states"} else iso if iso in inside else None
        elif regions & G.closure({iso}) and not regions & G.closure({state}):
            hit = iso
        else:
            hit = iso if len(parts) >= 3 and last and before and not ours else state
        found += [hit] if hit else []
    return G.closure(set(found))


TEXTS = [
    None, "", " ", "Austin, TX", "Manchester, England", "Berlin, DE", "Dover, DE", "Toronto, ON, CA", "Bangalore, Karnataka, IN", "Los Angeles, Orange County, CA", "San Jose, California, CA", "CA", "DE", "IN", "Remote", "Remote - US", "Multiple locations",
    "New South Wales", "New England", "Northern Ireland", "Paris, France; Berlin, Germany", "EMEA, Europe, DE", "Tel Aviv, IL", "Chicago, IL, USA", "U.S.A.", "the Netherlands", "São Paulo, Brasil", "Österreich", "Washington DC", "n/a", "USA", "U.K.", "DEU", "Hong Kong, HK", "Texas, New Zealand, IN",
]


def test_places_equal_the_plain_reading(spark):
    r = random.Random(3)
    pieces = [*COUNTRIES, *STATES, *list(G.names)[:60], "DE", "CA", "IN", "IL", "Springfield", "County Cork", "Remote", "or", "Europe", "DACH"]
    texts = TEXTS + [r.choice(["", " "]) + r.choice([", ", " ", " / "]).join(r.choice(pieces) for _ in range(r.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, h) for i, t in enumerate(texts) for h in ("", "germany", "united states")], "i int, t string, hint string")
    got = df.select("i", "hint", G.ids(F.col("t"), hint=F.col("hint")).alias("plain"), G.ids(F.col("t"), True).alias("field"), G.is_placeless(F.col("t")).alias("nowhere"), G.country_of(F.col("t")).alias("country")).collect()
    for x in got:
        t = texts[x["i"]]
        assert set(x["plain"]) == plain_ids(t, hint=x["hint"]), (t, x["hint"])
        assert set(x["field"]) == plain_ids(t, True), t
        assert x["nowhere"] == (all(w in PLACELESS for w in words(t)) and not (words(t) and plain_ids(t))), t
        inside = plain_ids(t, True) & set(COUNTRIES)
        assert x["country"] == (next(iter(inside)) if len(inside) == 1 else ""), t


def test_configured_places():
    assert {c: G.place_of(c) for c in ("USA", "TX", "u.k.", "Deutschland", "Springfield", "DE", "nordic")} == {"USA": "united states", "TX": "texas", "u.k.": "united kingdom", "Deutschland": "germany", "Springfield": None, "DE": "delaware", "nordic": "nordics"}


COLUMNS = "company_key int, name string, domain string, location string, country string, signal_places array<string>, employees int, industry string, keywords array<string>, description string, signal_titles array<string>"


def test_nine_reasons_in_order(spark):
    base = dict(company_key=0, name="Acme", domain="acme.com", location="Austin, TX", country="", signal_places=[], employees=50, industry="Software", keywords=["cloud"], description="tools", signal_titles=["Engineer"])
    cases = {
        None: {}, "domain b.com is on the suppression list": {"domain": "b.com", "name": "Gone Ltd"}, "company Gone Ltd is on the suppression list": {"name": "Gone Ltd"},
        "excluded domain x.org": {"domain": "x.org"}, "excluded domain eu.x.org (under x.org)": {"domain": "eu.x.org"}, "company name 'My Holding 3' matches excluded pattern 'holding \\d'": {"name": "My Holding 3"},
        "no website/domain (icp.require_domain is on)": {"domain": None}, "excluded keyword 'casino' in keywords": {"keywords": ["Casinos", "cloud"]}, "excluded keyword 'casino' in description": {"description": "a casino"},
        "no ICP keyword [cloud, engineer] in name, industry, keywords, description or signals": {"keywords": [], "signal_titles": ["Cook"]},
        "excluded location 'Texas' (Dallas, Texas)": {"location": "Dallas, Texas", "name": "T"}, "location not in ICP [US, Springfield] (got: Rome, Italy; FR)": {"location": "Rome, Italy", "country": "FR"}, "excluded location 'Texas' (signals in Dallas, TX)": {"location": "Remote", "signal_places": ["Dallas, TX", "anywhere"]},
        "too small (9 employees, min 10)": {"employees": 9}, "too large (501 employees, max 500)": {"employees": 501}, "excluded industry 'gambling' (Gambling)": {"industry": "Gambling"}, "industry not in ICP [software] (got: Steel)": {"industry": "Steel", "keywords": ["cloud"]},
        "location unknown": {"location": "Remote"}, "size unknown": {"employees": None}, "industry unknown": {"industry": None, "keywords": None, "description": None},
    }
    rows = [tuple((base | change | {"company_key": i}).values()) for i, change in enumerate(cases.values())]
    for change, row in zip(cases, rows, strict=True):
        assert len(row) == 11, change
    df = spark.createDataFrame(rows, COLUMNS).withColumn("location", F.when(F.col("location") == "Austin, TX", "Springfield, OH").otherwise(F.col("location")))
    suppression = spark.createDataFrame([("domain", "b.com"), ("company", "gone"), ("company", "gone")], "kind string, value string")
    wanted = dict(locations=["US", "Springfield"], exclude_locations=["Texas"], least_employees=10, most_employees=500, industries=["software"], exclude_industries=["gambling"], keywords=["cloud", "engineer"], exclude_keywords=["casino"], exclude_domains=["https://www.x.org/a"], exclude_name_patterns=[r"holding \d"], require_domain=True)
    got = {r["company_key"]: r["reason"] for r in fit.rejections(df, fit.Profile(**wanted), suppression).collect()}
    for i, reason in enumerate(cases):
        assert got[i] == (None if reason is None or reason.endswith("unknown") else reason), (i, reason)
    strict = {r["company_key"]: r["reason"] for r in fit.rejections(df, fit.Profile(**wanted | {"unknown_passes": False}), suppression).collect()}
    assert [strict[i] for i, reason in enumerate(cases) if reason and reason.endswith("unknown")] == [f"{r} (icp.unknown_passes is off)" for r in cases if r and r.endswith("unknown")]
    assert fit.rejections(df, fit.Profile()).where("reason IS NOT NULL").count() == 0
    assert fit.rejections(df.limit(0), fit.Profile(**wanted), suppression).count() == 0
