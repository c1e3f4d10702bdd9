"""Cleaning of raw cells and JSON values, as columns that stay in the JVM and so may stand inside higher-order functions.

Every function gives an empty string, not null, for what is missing or unusable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import once_for as let
from .text import BLANKS, BLOCK_TAGS, TAG, is_blank, is_blocked_domain, is_personal_email, is_valid_email, normalize_domain, normalize_text

# fixed values: members of an object that stand for it, and hosts that only show other firms' pages
NAME_KEYS = ("name", "display_name", "displayName", "label", "title", "text", "value")
PLATFORMS = (
    "doctolib", "booksy", "fresha", "vagaro", "calendly", "treatwell", "setmore", "acuityscheduling", "squareup", "schedulicity", "mindbodyonline", "styleseat", "genbook", "planity", "zocdoc",
    "jameda", "doctoralia", "docplanner", "znanylekarz", "miodottore", "practo", "healthgrades", "vitals", "ratemds", "simplybook", "timify", "salonized", "phorest", "gettimely", "youcanbookme",
    "opentable", "resy", "sevenrooms", "thefork", "lafourchette", "quandoo", "exploretock", "toasttab", "ubereats", "doordash", "grubhub", "deliveroo", "justeat", "just-eat", "lieferando", "thuisbezorgd",
    "menulog", "skipthedishes", "foodpanda", "wolt", "glovoapp", "chownow", "menufy", "slicelife", "tripadvisor", "booking", "airbnb", "expedia", "agoda", "trivago", "vrbo",
    "yelp", "yell", "yellowpages", "pagesjaunes", "gelbeseiten", "paginegialle", "paginasamarillas", "houzz", "angi", "angieslist", "homeadvisor", "thumbtack", "bark", "nextdoor", "checkatrade",
    "trustatrader", "mybuilder", "ratedpeople", "trustpilot", "foursquare", "zomato", "bbb", "manta", "etsy", "amazon", "ebay",
    "beacons", "taplink", "lnk", "campsite", "xing", "vk", "threads", "snapchat", "reddit", "medium", "github", "gitlab", "behance", "dribbble", "vimeo", "soundcloud",
)
PLATFORM_HOSTS = ("about.me", "bio.link", "apps.apple.com", "play.google.com")
# fixed values: second labels under countries, hosts of made-up addresses, words that name no company, letters written as two
SECOND_LABELS = ("co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go", "gob", "nom")
MADE_UP_HOSTS = ("domain.com", "example.com", "example.org", "example.net", "email.com", "test.com")
SMALL_WORDS = ("and", "the", "for", "und", "des", "les", "der", "die", "das", "von")
TWO_LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "æ": "ae", "Æ": "Ae", "ø": "oe", "Ø": "Oe", "å": "aa", "Å": "Aa", "œ": "oe"}
# fixed values: what exports call the states of an address
STATUS_WORDS = {
    "valid": ("verified", "valid", "deliverable", "ok", "safe", "safe_to_send", "good", "valid_email"),
    "risky": ("catch_all", "catchall", "accept_all", "acceptall", "risky", "accept_all_unverifiable", "catch_all_email"),
    "invalid": ("invalid", "bounced", "bounce", "undeliverable", "bad", "do_not_mail", "disposable", "spamtrap", "hard_bounce", "invalid_email"),
    "unknown": ("guessed", "extrapolated", "unavailable", "unknown", "unverified", "pending", "not_verified", "none", "unverifiable"),
}
GOOD_WORDS = ("verified", "valid", "deliverable", "validated", "ok", "safe", "good")
PENDING_WORDS = ("pending", "need", "require", "validation", "validating", "verification", "verifying", "processing", "queue", "progress", "checking", "to_verify", "to_validate", "todo", "unchecked", "not_checked", "waiting", "retry")
# fixed values: titles before and letters after a name, small words that begin a family name
HONORIFICS = ("dr", "mr", "mrs", "ms", "miss", "mx", "prof", "sir")
CREDENTIALS = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "mba", "cpa", "cfa", "esq", "pmp")
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "da", "di", "du", "dos", "das", "le", "la", "ter", "ten", "zu", "st")


#: The white space of Unicode, and the length of the longest word for an empty cell.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LONGEST_BLANK = max(map(len, BLANKS))


def no(c: Column) -> Column:
    """An empty string for null."""
    return F.coalesce(c, F.lit(""))


def any_of(c: Column, names) -> Column:
    """Whether it is one of many names, as one pattern."""
    return c.rlike("^(?:" + "|".join(re.escape(n) for n in names) + ")$")


def first_of(*cs: Column) -> Column:
    """The first that is not empty."""
    if len(cs) == 1:
        return no(cs[0])
    return no(F.get(F.filter(F.array(*cs), lambda x: x != ""), F.lit(0)))


def once(items: Column) -> Column:
    """A list of strings without empty ones and without repeats in another case; the first stays."""
    return let(F.filter(items, lambda x: x != ""), lambda kept: let(F.transform(kept, F.lower), lambda lower: F.filter(kept, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)))


def as_text(c: Column, kind: T.DataType) -> Column:
    """Plain text of a value: lists joined, objects by their name; blank words and booleans are empty."""
    if isinstance(kind, T.StringType):
        t = F.btrim(c, F.lit(SPACES))
        return F.when((F.char_length(t) > LONGEST_BLANK) | ~is_blank(t), t).otherwise("")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return no(F.when(F.isnan(c), "").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string")))
    if isinstance(kind, T.DecimalType):
        digits = c.cast("string")
        return no(F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "") if kind.scale else digits)
    if isinstance(kind, T.ArrayType):
        return no(F.array_join(once(F.transform(c, lambda x: as_text(x, kind.elementType))), ", "))
    if isinstance(kind, T.StructType):
        named = [as_text(c[k], kind[k].dataType) for k in NAME_KEYS if k in kind.names]
        return first_of(*named) if named else F.lit("")
    if isinstance(kind, T.MapType):
        return first_of(*(as_text(c[k], kind.valueType) for k in NAME_KEYS))
    if isinstance(kind, T.VariantType):
        return variant_text(c)
    if isinstance(kind, T.BooleanType):
        return F.lit("")
    return no(c.cast("string"))


def variant_text(c: Column) -> Column:
    """as_text of a VARIANT: of lists in lists and objects in objects nothing is read."""

    def read(v: Column, kind: Column, listed: Column | None) -> Column:
        inner = F.filter(F.array(*(F.try_variant_get(v, f"$.{k}", "string") for k in NAME_KEYS)), lambda x: ~is_blank(x) & ~x.rlike(r"^[\[{]|^(?:true|false)$"))
        out = F.when(kind.isNull() | kind.isin("BOOLEAN", "VOID"), "").when(kind.startswith("OBJECT"), F.btrim(F.get(inner, F.lit(0)))).when(kind.startswith("ARRAY"), "" if listed is None else listed)
        out = out.when(kind == "DOUBLE", as_text(F.try_variant_get(v, "$", "double"), T.DoubleType()))
        out = out.when(kind.startswith("DECIMAL"), as_text(F.try_variant_get(v, "$", "decimal(38,9)"), T.DecimalType(38, 9)))
        return no(out.otherwise(as_text(F.try_variant_get(v, "$", "string"), T.StringType())))

    known = lambda x: F.struct(x.alias("v"), F.schema_of_variant(x).alias("kind"))
    each = lambda x: let(known(x), lambda s: read(s["v"], s["kind"], None))
    return let(known(c), lambda s: read(s["v"], s["kind"], F.array_join(once(F.transform(F.try_variant_get(s["v"], "$", "array<variant>"), each)), ", ")))


def unescape(c: Column) -> Column:
    """Entities of HTML 4, &apos; and numeric ones, with their semicolon."""
    return F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.replace(c, F.lit("&apos;"), F.lit("'")))


def clean_text(c: Column, limit: int = 0) -> Column:
    """Text without tags and entities, white space collapsed, cut to limit characters with an ellipsis."""

    def bare(x: Column) -> Column:
        t = F.when(x.rlike(r"&lt;\s*/?\s*[a-zA-Z!]") & ~x.rlike(TAG), unescape(x)).otherwise(x)
        for pattern, to in ((r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), (rf"(?i)</?(?:{BLOCK_TAGS})\b[^<>]*>", " "), (TAG, "")):
            t = F.regexp_replace(t, pattern, to)
        return unescape(t)

    t = let(c, lambda x: F.when(x.rlike("[<&]"), bare(x)).otherwise(x))  # most cells hold neither
    t = F.btrim(F.regexp_replace(F.translate(t, "\u00a0\u200b", " "), r"(?U)\s+", " "))
    # a longer text keeps one character less for the ellipsis, and no blank before it
    return F.regexp_replace(t, rf"(?s)^(?=.{{{limit + 1}}})(.{{{limit - 2}}})(?: |(\S)).*$", "$1$2…") if limit else t


def clean_url(c: Column) -> Column:
    return let(F.btrim(unescape(c)), lambda t: F.when(t.rlike(r"(?U)\s") | ~(t.contains(".") | t.contains("://")), "").otherwise(t))


def safe_host(c: Column) -> Column:
    """Host of a URL, an address or a host, brackets left out."""
    return no(let(F.translate(c, "[]", ""), normalize_domain))


def registrable_name(host: Column) -> Column:
    """The label that names a domain: tripadvisor of www.tripadvisor.co.uk; no list of public suffixes is asked."""

    def named(parts: Column) -> Column:
        n = F.size(parts)
        at = lambda k: F.get(parts, n - k)
        return F.when(n < 2, at(1)).when((n >= 3) & (F.length(at(1)) == 2) & any_of(at(2), SECOND_LABELS), at(3)).otherwise(at(2))

    return no(let(F.filter(F.split(F.lower(host), r"\."), lambda p: p != ""), named))


def _shows_others(c: Column, host: Column) -> Column:
    shown = any_of(registrable_name(host), PLATFORMS) | host.rlike(rf"(^|\.)({'|'.join(h.replace('.', '[.]') for h in PLATFORM_HOSTS)})$")
    rest = F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    path, query = F.regexp_extract(rest, r"^[^/?]*/?([^?]*)", 1), F.regexp_extract(rest, r"\?(.+)$", 1)
    trivial = F.regexp_replace(path, "^/+|/+$", "").rlike(r"(?i)^(?:[a-z]{2}(?:[-_][a-z]{2,4})?|index\.[a-z]{3,4}|home|default\.aspx?)?$")
    return ~c.contains("@") & (host != "") & shown & ((query != "") | ~trivial)


def is_platform_url(c: Column) -> Column:
    """A page on a platform that shows many firms; the platform's own start page is none."""
    return let(F.struct(c.alias("c"), safe_host(c).alias("host")), lambda s: _shows_others(s["c"], s["host"]))


def clean_domain(c: Column) -> Column:
    """A company's own host, or empty."""
    return website_parts(c)["domain"]


def website_parts(c: Column) -> Column:
    """struct(url, domain, foreign, linkedin, shows) of a cleaned address: the company's own host or empty; whether it is on
    a host that is no company's own; on LinkedIn; a page on a platform that shows many firms. Each is computed once."""
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"

    def judged(s: Column) -> Column:
        url, host = s["url"], s["host"]
        return F.struct(url.alias("url"), host.alias("host"), F.coalesce(is_blocked_domain(host), F.lit(False)).alias("foreign"), _shows_others(url, host).alias("shows"))

    def parts(s: Column) -> Column:
        good = s["host"].rlike(rf"^{label}(?:\.{label})+$") & ~s["foreign"] & ~s["shows"]
        return F.struct(s["url"].alias("url"), F.when(good, s["host"]).otherwise("").alias("domain"), s["foreign"].alias("foreign"), s["host"].contains("linkedin.com").alias("linkedin"), s["shows"].alias("shows"))

    return let(c, lambda url: let(let(F.struct(url.alias("url"), safe_host(url).alias("host")), judged), parts))


def clean_email(c: Column) -> Column:
    def own(t: Column) -> Column:
        made_up = any_of(F.substring_index(t, "@", -1), MADE_UP_HOSTS) | t.startswith("email_not_unlocked")
        return F.when(is_valid_email(t) & ~made_up, t).otherwise("")

    return let(F.regexp_replace(F.lower(F.btrim(c)), "^mailto:", ""), own)


def domain_matches_name(host: Column, name: Column) -> Column:
    """Whether a host may be the own one of a company of this name: by its words joined, one word of three letters or
    more, or its initials. A name without Latin letters cannot be judged and matches."""
    core = let(F.filter(F.split(F.lower(host), r"\."), lambda p: p != ""), lambda p: F.array_join(F.when(F.size(p) > 1, F.slice(p, 1, F.size(p) - 1)).otherwise(p), ""))
    spelt = no(name)
    for letter, two in TWO_LETTERS.items():
        spelt = F.replace(spelt, F.lit(letter), F.lit(two))
    as_words = lambda text: F.filter(F.split(normalize_text(text), " "), lambda w: w != "")
    known = F.struct(F.replace(core, F.lit("-"), F.lit("")).alias("core"), F.replace(registrable_name(host), F.lit("-"), F.lit("")).alias("label"), as_words(name).alias("plain"), as_words(spelt).alias("spelt"))

    def words_match(words: Column, core: Column, label: Column) -> Column:
        compact = F.array_join(words, "")
        initials = F.array_join(F.transform(F.filter(words, lambda w: ~any_of(w, SMALL_WORDS)), lambda w: F.substring(w, 1, 1)), "")
        one = F.exists(words, lambda w: (F.length(w) >= 3) & ~any_of(w, SMALL_WORDS) & F.contains(core, w))
        short = let(initials, lambda i: (F.length(i) >= 2) & ((label == i) | ((F.length(i) >= 3) & F.startswith(label, i))))
        return (F.size(words) > 0) & (F.contains(core, compact) | ((F.length(core) >= 4) & F.contains(compact, core)) | one | short)

    return let(known, lambda k: (F.size(k["plain"]) == 0) | ((k["core"] != "") & (words_match(k["plain"], k["core"], k["label"]) | words_match(k["spelt"], k["core"], k["label"]))))


def email_status(c: Column) -> Column:
    """valid, risky, invalid or unknown; only what clearly says valid is valid."""

    def status_of(s: Column) -> Column:
        out = F.when(s == "", "unknown")
        for status, words in STATUS_WORDS.items():
            out = out.when(any_of(s, words), status)
        out = out.when(s.rlike(r"(?:^|_)(?:not|non|no|never)_?(?:valid|deliverable)(?:_|$)") | s.rlike("invalid|bounce|undeliverable|disposable|spamtrap"), "invalid")
        out = out.when(s.rlike(r"(?:^|_)(?:not|non|no|never|un|cannot|unable)_?(?:verif|valid|deliver|confirm|check)") | s.rlike("unverified|unknown|guess|" + "|".join(PENDING_WORDS)), "unknown")
        out = out.when(s.rlike("catch|accept|risky"), "risky").when(s.rlike(r"(?:^|_)(?:not|non|no|never|un)(?:_|$)"), "unknown")
        return out.when(s.rlike(rf"(?:^|_)(?:{'|'.join(GOOD_WORDS)})(?:_|$)"), "valid").otherwise("unknown")

    return let(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), status_of)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _bare(w: Column) -> Column:
    return F.replace(normalize_text(w), F.lit(" "), F.lit(""))


def _from(items: Column, start: Column) -> Column:
    """The items from a place (from 0) on."""
    return F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0)))


def _leading(items: Column, tests) -> Column:
    """How many first items pass."""
    return let(F.transform(items, tests), lambda ok: F.when(F.array_position(ok, False) == 0, F.size(ok)).otherwise(F.array_position(ok, False).cast("int") - 1))


def split_full_name(c: Column) -> Column:
    """struct(first, last) of a whole name, spelling kept: without parentheses, titles before and letters after it;
    "Last, First" is turned round. A title and one word are a last name."""
    only_letters = lambda p: let(F.filter(F.transform(words(p), _bare), lambda w: w != ""), lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: any_of(w, CREDENTIALS)))
    parts = F.transform(F.split(F.regexp_replace(no(c), r"\([^)]*\)", " "), ","), lambda p: F.btrim(p))
    cut = let(parts, lambda p: F.struct(words(F.get(p, F.lit(0))).alias("head"), words(no(F.get(F.filter(_from(p, F.lit(1)), lambda x: (x != "") & ~only_letters(x)), F.lit(0)))).alias("given")))

    def in_order(s: Column) -> Column:
        turned = (F.size(s["given"]) > 0) & (F.size(s["head"]) > 0) & ((F.size(s["head"]) == 1) | any_of(F.lower(F.get(s["head"], F.lit(0))), PARTICLES))
        return F.when(turned, F.concat(s["given"], s["head"])).when(F.size(s["head"]) > 0, s["head"]).otherwise(s["given"])

    def without_title(w: Column) -> Column:
        return let(_leading(w, lambda x: any_of(_bare(x), HONORIFICS)), lambda n: F.struct((n > 0).alias("titled"), _from(w, n).alias("w")))

    def without_letters(s: Column) -> Column:
        n = F.least(_leading(F.reverse(s["w"]), lambda x: any_of(_bare(x), CREDENTIALS)), F.greatest(F.size(s["w"]) - 1, F.lit(0)))
        return F.struct(s["titled"].alias("titled"), F.slice(s["w"], F.lit(1), F.greatest(F.size(s["w"]) - n, F.lit(0))).alias("w"))

    def parted(s: Column) -> Column:
        one = no(F.get(s["w"], F.lit(0)))
        lone = s["titled"] & (F.size(s["w"]) == 1)
        return F.struct(F.when(lone, "").otherwise(one).alias("first"), F.when(lone, one).otherwise(F.array_join(_from(s["w"], F.lit(1)), " ")).alias("last"))

    return let(let(let(let(cut, in_order), without_title), without_letters), parted)


def name_parts(first: Column, last: Column, full: Column) -> Column:
    """struct(first, last): the missing one of two parts is read from the full name, both if neither is given."""

    def read(s: Column) -> Column:
        first, last, full, w = s["first"], s["last"], s["full"], s["w"]
        place = F.array_position(F.transform(w, F.lower), F.lower(first)).cast("int")
        after = F.when(F.startswith(F.lower(full), F.concat(F.lower(first), F.lit(" "))), F.btrim(F.substr(full, F.length(first) + 1))).when(place > 0, F.array_join(_from(w, place), " ")).otherwise(F.array_join(_from(w, F.lit(1)), " "))
        before = words(F.substr(full, F.lit(1), F.greatest(F.length(full) - F.length(last), F.lit(0))))
        leading = F.when(F.endswith(F.lower(full), F.concat(F.lit(" "), F.lower(last))), no(F.get(before, F.lit(0)))).when((F.size(w) > 1) & (F.lower(F.get(w, F.lit(0))) != F.lower(last)), F.get(w, F.lit(0))).otherwise("")
        return (
            F.when((full == "") | ((first != "") & (last != "")), F.struct(first.alias("first"), last.alias("last")))
            .when((first == "") & (last == ""), split_full_name(full)).when(first != "", F.struct(first.alias("first"), after.alias("last")))
            .otherwise(F.struct(leading.alias("first"), last.alias("last")))
        )

    return let(F.struct(first.alias("first"), last.alias("last"), full.alias("full"), words(full).alias("w")), read)


def is_free_email(c: Column) -> Column:
    return is_personal_email(c)
