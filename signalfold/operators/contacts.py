"""People: parts of names, guessed addresses, ranks and the choice of whom to write to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import CREDENTIALS, HONORIFICS, let
from ..functions.text import is_valid_email, normalize_text, strip_accents

# fixed values: patterns in the order they are tried, names of their parts, letters that NFKD does not fold
PATTERNS = ("{first}.{last}", "{first}", "{f}{last}", "{first}{last}", "{f}.{last}", "{first}_{last}", "{first}{l}", "{last}")
PARTS = {"first": ("first", "first_name", "firstname", "fn"), "last": ("last", "last_name", "lastname", "ln"), "f": ("f", "fi", "first_initial"), "l": ("l", "li", "last_initial")}
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "ae", "ø": "o", "Ø": "o", "œ": "oe", "Œ": "oe", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ı": "i", "ĸ": "k", "ŋ": "n"}
#: Order of address statuses; others count as unknown.
STATUSES = ("valid", "risky", "unknown", "invalid")


def name_token(c: Column, is_first: bool = False) -> Column:
    """A name's part in lower-case ASCII letters and digits, without remarks, what follows a comma, credentials and, of a
    first name, honorifics."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " "), ",(?s:.*)$", "")
    for letter in [x for x in LETTERS if len(LETTERS[x]) > 1]:
        t = F.replace(t, F.lit(letter), F.lit(LETTERS[letter]))
    single = [x for x in LETTERS if len(LETTERS[x]) == 1]
    t = F.lower(strip_accents(F.translate(t, "".join(single), "".join(LETTERS[x] for x in single))))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", ""), r"\s+", " "))
    if is_first:
        t = F.regexp_replace(t, f"^(?:(?:{'|'.join(HONORIFICS)}) )+(?=.)", "")
    return F.replace(F.regexp_replace(t, f"(?<=.)(?: (?:{'|'.join(CREDENTIALS)}))+$", ""), F.lit(" "), F.lit(""))


def normalize_pattern(pattern: str) -> str | None:
    """A pattern with the parts {first}, {last}, {f} and {l} of one written with other names or as "first.last"."""
    p = pattern.strip().split("@", 1)[0].strip()
    known = {name: part for part, names in PARTS.items() for name in names}
    if "{" in p:
        pieces = re.findall(r"\{([^{}]*)\}|([^{}]+)", p)
        if any(part and part.strip().lower() not in known for part, _ in pieces) or any(re.search(r"[^\w.-]", rest) for _, rest in pieces):
            return None
        return "".join("{" + known[part.strip().lower()] + "}" if part else rest.lower() for part, rest in pieces) or None
    pieces = re.findall(r"firstname|lastname|first|last|f|l|[._-]|.", p.lower())
    if not pieces or any(x not in known and x not in "._-" for x in pieces):
        return None
    return "".join("{" + known[x] + "}" if x in known else x for x in pieces)


def render_pattern(pattern: str, first: Column, last: Column) -> Column:
    """The local part of a pattern (a configured one, normalised); null if a part of the name is missing."""
    values = {"first": first, "last": last, "f": F.substring(first, 1, 1), "l": F.substring(last, 1, 1)}
    parts = [F.nullif(values[part], F.lit("")) if part else F.lit(rest) for part, rest in re.findall(r"\{(first|last|f|l)\}|([^{}]+)", pattern)]
    return F.nullif(F.btrim(F.concat(*parts), F.lit("._-")), F.lit(""))


def candidates(first: Column, last: Column, domain: Column, known: Column | None = None, patterns: tuple[str, ...] = PATTERNS, most: int = 0) -> Column:
    """Guessed addresses in order, each once: those of the patterns, after `known` (addresses); none without a first name."""
    made = list(dict.fromkeys(p for p in map(normalize_pattern, patterns) if p))

    def of_tokens(token: Column) -> Column:
        guesses = F.array(*[F.concat(render_pattern(p, token["f"], token["n"]), F.lit("@"), domain) for p in made])
        every = F.concat(F.transform(known, lambda e: F.lower(F.trim(e))), guesses) if known is not None else guesses
        good = F.array_distinct(F.filter(every, lambda e: e.isNotNull() & is_valid_email(e)))
        return F.when(F.coalesce(domain != "", F.lit(False)) & (token["f"] != ""), good).otherwise(F.array().cast("array<string>"))

    good = let(F.struct(name_token(first, True).alias("f"), name_token(last).alias("n")), of_tokens)
    return F.slice(good, 1, most) if most else good


def contact_key(email: Column, linkedin: Column, full_name: Column) -> Column:
    """What a contact is known by: address, else profile, else normalised name."""
    text = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(text(email), text(F.lower(F.regexp_replace(linkedin, "/+$", ""))), normalize_text(full_name))


def rank_order(title_rank: Column, email: Column, status: Column, confidence: Column) -> list[Column]:
    """Buyers' titles by rank first, then people with an address, by its status, then by the source's confidence."""
    has = F.coalesce(email != "", F.lit(False))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status), F.lit(0)) - 1, F.lit(2))
    return [title_rank.isNull().asc(), F.coalesce(title_rank, F.lit(0)).asc(), (~has).asc(), F.when(has, place).otherwise(4).asc(), F.coalesce(confidence, F.lit(0.0)).desc()]


def select_contacts(contacts: DataFrame, limit: int = 1, allow_generic: bool = False) -> DataFrame:
    """The best `limit` people of each company, of contacts (company_key, pos, full_name, email, email_status, confidence,
    linkedin_url, title_rank, excluded, generic): without excluded ones and role mailboxes without a name; a named
    person's role mailbox is taken away. Of equal keys the best stays; ties go by pos."""
    rows = contacts.where(~F.col("excluded"))
    if not allow_generic:
        rows = rows.where(~F.col("generic") | (F.coalesce(F.trim("full_name"), F.lit("")) != ""))
        rows = rows.withColumn("email_status", F.when(F.col("generic"), "unknown").otherwise(F.col("email_status"))).withColumn("email", F.when(F.col("generic"), "").otherwise(F.col("email")))
    rows = rows.withColumn("contact_key", contact_key(F.col("email"), F.col("linkedin_url"), F.col("full_name"))).where("contact_key <> ''")
    order = [*rank_order(F.col("title_rank"), F.col("email"), F.col("email_status"), F.col("confidence")), F.col("pos").asc()]
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("company_key", "contact_key").orderBy(*order))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("company_key").orderBy(*order))).where(F.col("place") <= limit)
