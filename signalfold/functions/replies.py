"""What a person wrote in a mail: tags, quoted history, signatures and sign-offs cut, as column expressions.

A reply is read as a list of lines. The first line that begins the history or the signature is found by tests on a line and
those after it, and the sign-off by tests from the end. Nested quotes of HTML are left out by a fold over their tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import let, no, unescape

# fixed values: tags that show that a text is HTML, elements without text, and what mail programs call the quoted part
HTML_TAGS = ("html", "body", "head", "div", "p", "br", "span", "table", "tbody", "tr", "td", "blockquote", "a", "b", "i", "u", "strong", "em", "font", "ul", "ol", "li", "hr", "img", "meta", "style", "h[1-6]", "center", "section")
WITHOUT_TEXT = ("head", "style", "script", "title")
QUOTE_NAMES = ("gmail_quote", "gmail_extra", "yahoo_quoted", "moz-cite-prefix", "divRplyFwdMsg", "appendonsend", "OutlookMessageHeader", "protonmail_quote", "zmail_extra", "reply-quote", "x_divRplyFwdMsg")
LINE_ENDS = ("br", "/p", "/div", "/li", "/tr", "/h[1-6]", "/table", "/ul", "/ol", "hr")
# fixed values: words of the line before a quotation, of forwarded messages and of mail headers, in several languages
WROTE = ("wrote", "writes", "schrieb", r"a\s+écrit", "escribió", r"ha\s+scritto", "schreef", "escreveu", "skrev", "napisał")
ON = ("on", "am", "le", "el", "il", "op", "em", "den", "på", "dnia")
FORWARDED = ("original message", "forwarded message", "begin forwarded message", "ursprüngliche nachricht", "message d'origine", "mensaje original", "messaggio originale", "oorspronkelijk bericht", "mensagem original")
FROM = ("from", "von", "de", "da", "van", "från", "fra", "od")
HEADERS = (
    "sent", "date", "to", "subject", "cc", "gesendet", "datum", "an", "betreff", "envoyé", "à", "objet", "enviado", "fecha", "para", "asunto",
    "inviato", "data", "oggetto", "verzonden", "onderwerp", "aan", "skickat", "ämne", "till",
)
# fixed values: footers of phones, and closing words
FOOTERS = (r"sent\s+from\s+my\b", r"sent\s+from\s+(?:outlook|mail\s+for|yahoo|gmail|samsung|proton)", r"get\s+outlook\s+for\b", r"sent\s+via\s+\w+", r"envoyé\s+de\s+mon", r"von\s+meinem\s+.{0,30}gesendet", r"enviado\s+desde\s+mi")
CLOSINGS = (
    "best", "best regards", "best wishes", "kind regards", "warm regards", "warmest regards", "regards", "many thanks", "thanks", "thanks again", "thank you", "thx", "cheers", "sincerely",
    "yours sincerely", "yours truly", "all the best", "br", "talk soon", "speak soon", "cordially", "respectfully",
)


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


QUOTE_LINE = rf"(?iU)^{_any(ON)}\b.{{0,300}}?\b{_any(WROTE)}\s*:?\s*$"
QUOTE_START = rf"(?iU)^{_any(ON)}\b"
QUOTE_VERB = rf"(?iU)^.{{0,300}}\b{_any(WROTE)}\s*:\s*$"
FORWARD_LINE = rf"(?iU)^[-_=*\s]*{_any(FORWARDED)}[-_=*:\s]*$"
FROM_LINE = rf"(?iU)^\*?{_any(FROM)}\s*:\*?\s*\S"
HEADER_LINE = rf"(?iU)^\*?{_any(HEADERS)}\s*:"
FOOTER_LINE = rf"(?iU)^{_any(FOOTERS)}"
NAME = r"\p{Lu}[\p{L}\p{N}_'’.\-]*"
CLOSING_LINE = rf"^(?i:{_any(CLOSINGS)})[ \t]*[,.!\-–—]*[ \t]*({NAME}(?:[ \t]+{NAME}){{0,2}})?[ \t]*$"
NAME_LINE = rf"^[-–—~\s]*{NAME}(?:\s+{NAME}){{0,3}}\s*,?$"


def outside_quotes(c: Column) -> Column:
    """HTML without quotations, however deep they are nested; what follows an unclosed one goes too."""

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.rlike("(?i)^<blockquote"), piece.rlike("(?i)^</blockquote")
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        bare = F.when(closes, F.regexp_replace(piece, "(?i)^</blockquote[^<>]*>", "")).otherwise(piece)
        more = F.when(opens, F.when(state["depth"] == 0, "\n").otherwise("")).when(depth == 0, bare).otherwise("")
        return F.struct(depth.alias("depth"), F.concat(state["text"], more).alias("text"))

    return F.aggregate(F.split(c, r"(?i)(?=</?blockquote\b)"), F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step, lambda s: s["text"])


def html_text(c: Column, quoted: bool = False) -> Column:
    """Text of a mail in HTML with its lines; quoted history only if asked for."""
    t = F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", " ")
    t = F.regexp_replace(t, rf"(?is)<({'|'.join(WITHOUT_TEXT)})\b[^<>]*>.*?</\1\s*>", " ")
    if not quoted:
        names = "|".join(QUOTE_NAMES)
        t = outside_quotes(F.regexp_replace(t, rf"(?is)<[a-z][a-z0-9]*\b[^<>]{{0,500}}?\b(?:class|id)\s*=\s*[\"']?[^\"'<>]{{0,200}}?(?:{names}).*$", ""))
    t = F.regexp_replace(t, rf"(?i)<\s*(?:{'|'.join(LINE_ENDS)})\b[^<>]*>", "\n")
    return unescape(F.regexp_replace(F.regexp_replace(t, r"(?i)<\s*li\b[^<>]*>", "\n- "), "<[^<>]*>", ""))


def plain_lines(c: Column, quoted: bool = False) -> Column:
    """The lines of a mail, HTML or not."""
    t = F.regexp_replace(no(c), r"\r\n?", "\n")
    is_html = rf"(?i)<\s*/?\s*(?:{'|'.join(HTML_TAGS)})\b[^<>]*>"
    text = let(t, lambda x: F.when(x.rlike(is_html), html_text(x, quoted)).otherwise(unescape(x)))
    return F.split(F.translate(text, " ​", " "), "\n")


def written_lines(lines: Column) -> Column:
    """The lines before the quoted history, without lines marked as quoted; none of them blank, all trimmed."""
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))

    def kept(s: Column) -> Column:
        def begins(line: Column, i: Column) -> Column:
            after = F.slice(s["t"], i + 2, F.lit(4))
            following = F.get(s["t"], i + 1)
            both = F.concat(line, F.lit(" "), following)
            split_line = line.rlike(QUOTE_START) & following.isNotNull() & (F.length(both) < 400) & both.rlike(QUOTE_LINE)
            rest = lambda: F.get(F.filter(F.slice(s["t"], i + 2, F.greatest(F.size(s["t"]), F.lit(1))), lambda x: x != ""), F.lit(0))
            rule = F.when(line.rlike(r"^_{5,}$"), F.coalesce(rest().rlike(FROM_LINE), F.lit(False))).otherwise(False)
            headed = F.when(line.rlike(FROM_LINE), F.exists(after, lambda x: x.rlike(HEADER_LINE))).otherwise(False)
            quotes = line.rlike(QUOTE_LINE) | (line.rlike(QUOTE_VERB) & line.rlike(r"[@\p{Nd}]")) | split_line | line.rlike(FORWARD_LINE)
            return ~line.startswith(">") & ((line == "--") & ~F.get(s["raw"], i).rlike(r"^\s") | F.coalesce(quotes, F.lit(False)) | rule | headed | line.rlike(FOOTER_LINE))

        at = F.array_position(F.transform(s["t"], begins), True).cast("int")
        return F.filter(F.when(at > 0, F.slice(s["t"], F.lit(1), at - 1)).otherwise(s["t"]), lambda x: (x != "") & ~x.startswith(">"))

    return let(F.struct(lines.alias("raw"), trimmed.alias("t")), kept)


def without_signoff(lines: Column) -> Column:
    """Lines without a last "Thanks, Jane" and what follows it, if a name or nothing follows and the block is short."""

    def cut(s: Column) -> Column:
        n, w = F.size(s["w"]), s["w"]
        at = n - F.array_position(F.reverse(F.transform(w, lambda x: x.rlike(CLOSING_LINE))), True).cast("int")  # n if there is none
        line, after = F.get(w, at), F.slice(w, at + 2, F.greatest(n, F.lit(1)))
        good = (at < n) & (at > F.greatest(n - 8, F.lit(0))) & F.forall(after, lambda x: F.length(x) <= 80)
        named = (F.size(after) == 0) | (F.regexp_extract(line, CLOSING_LINE, 1) != "") | F.coalesce(F.get(after, F.lit(0)).rlike(NAME_LINE), F.lit(False))
        return F.when(good & named, F.slice(w, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(w)

    return let(F.struct(lines.alias("w")), cut)


def clean_reply(c: Column) -> Column:
    """Only what the person wrote, as one line; empty for null. Whole texts are read, however long."""
    return F.btrim(F.regexp_replace(F.array_join(without_signoff(written_lines(plain_lines(c))), " "), r"(?U)\s+", " "))
