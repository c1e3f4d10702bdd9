"""Reply texts against a plain reading line by line."""

import html
import random
import re

from pyspark.sql import functions as F

from signalfold.functions import replies

PY = lambda pattern: pattern.replace("(?iU)", "(?i)").replace(r"\p{Lu}", "[A-ZÉÄÖÜ]").replace(r"\p{L}\p{N}_", r"\w")


def plain(text, quoted=False):
    """The same definition with loops."""
    s = re.sub("\r\n?", "\n", text or "")
    if re.search(rf"(?i)<\s*/?\s*(?:{'|'.join(replies.HTML_TAGS)})\b[^<>]*>", s):
        s = re.sub(r"(?s)<!--.*?(?:-->|\Z)", " ", s)
        s = re.sub(rf"(?is)<({'|'.join(replies.WITHOUT_TEXT)})\b[^<>]*>.*?</\1\s*>", " ", s)
        m = re.search(rf"(?i)<[a-z][a-z0-9]*\b[^<>]{{0,500}}?\b(?:class|id)\s*=\s*[\"']?[^\"'<>]{{0,200}}?(?:{'|'.join(replies.QUOTE_NAMES)})", s)
        s = s[: m.start()] if m else s
        while True:  # innermost first
            less = re.sub(r"(?is)<blockquote\b[^<>]*>(?:(?!<blockquote\b).)*?</blockquote\s*>", "\n", s)
            if less == s:
                break
            s = less
        m = re.search(r"(?i)<blockquote\b", s)
        s = s[: m.start()] if m else s
        s = re.sub(rf"(?i)<\s*(?:{'|'.join(replies.LINE_ENDS)})\b[^<>]*>", "\n", s)
        s = re.sub("<[^<>]*>", "", re.sub(r"(?i)<\s*li\b[^<>]*>", "\n- ", s))
    lines, kept = html.unescape(s).replace("\xa0", " ").replace("​", "").split("\n"), []
    for i, raw in enumerate(lines):
        line, after = raw.strip(), [x.strip() for x in lines[i + 1 :]]
        if line.startswith(">"):
            continue
        test = lambda p, x=line: re.search(PY(p), x) is not None
        both = f"{line} {after[0]}" if after else ""
        following = next((x for x in after if x), "")
        if raw.rstrip() == "--" or (line and (test(replies.QUOTE_LINE) or (test(replies.QUOTE_VERB) and re.search(r"[@\d]", line)) or (test(replies.QUOTE_START) and after and len(both) < 400 and test(replies.QUOTE_LINE, both)) or test(replies.FORWARD_LINE) or (re.search("^_{5,}$", line) and test(replies.FROM_LINE, following)) or (test(replies.FROM_LINE) and any(test(replies.HEADER_LINE, x) for x in after[:4])) or test(replies.FOOTER_LINE))):
            break
        kept.append(line)
    w = [x for x in kept if x]
    for at in range(len(w) - 1, max(0, len(w) - 8), -1):
        if m := re.search(PY(replies.CLOSING_LINE), w[at]):
            rest = w[at + 1 :]
            if all(len(x) <= 80 for x in rest) and (not rest or m[1] or re.search(PY(replies.NAME_LINE), rest[0])):
                w = w[:at]
            break
    return re.sub(r"\s+", " ", " ".join(w)).strip()


CASES = {
    "Sounds good.\n\nBest,\nJane Doe\nCFO": "Sounds good.", "Yes please\n\nOn Mon, Sep 21, 2026 at 9:00 AM Bob <b@x.com> wrote:\n> hi\n> there": "Yes please", "No\n-----Original Message-----\nFrom: x": "No",
    "ok\nOn Monday Bob Smith\n<bob@x.com> wrote:\n> a": "ok", "Call me\nSent from my iPhone": "Call me", "fine\n-- \nJane": "fine", "a\n> quoted\nb": "a b", "x\n__________\n\nFrom: Bob": "x", "x\nFrom: Bob\nSent: today\nTo: me": "x", "From: here on\nnothing": "From: here on nothing",
    "Am 3.4. hat Eva\nschrieb:\n> a": "", "thanks Bob wrote 3 times": "thanks Bob wrote 3 times", "Thanks, Jane": "Thanks, Jane", "Hello\nThanks, Jane": "Hello", "Hi\nThanks\nwe will see": "Hi Thanks we will see",
    "<div>Yes<br>more &amp; more</div><blockquote>old <blockquote>older</blockquote> old</blockquote><p>end</p>": "Yes more & more end", "<p>a</p><div class=\"gmail_quote\">b</div>": "a", "<p>a</p><blockquote>never closed": "a", "<style>x{}</style><ul><li>one<li>two</ul>": "- one - two", "<!-- c --><b>t</b><!-- open": "t", "a</blockquote>b<p>": "ab",
    "": "", " \n ": "", None: "",
}


def test_known_replies(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", replies.clean_reply(F.col("t")).alias("x")).collect()}
    for i, (text, want) in enumerate(CASES.items()):
        assert got[i] == want == plain(text), text


def test_replies_equal_the_plain_reading(spark):
    r = random.Random(7)
    lines = ["Thanks for this.", "On Tue, Bob wrote:", "> old text", "--", " --", "Best regards,", "Jane Doe", "Cheers", "From: Bob", "Sent: Monday", "", "  ", "_____", "Le 3 mai, Eva a écrit :", "Get Outlook for iOS", "I wrote: 5", "we met on Monday", "Kind regards, Éva", "x" * 90, "Begin forwarded message:", "Subject: hi", "1 & 2 &lt;3"]
    tags = ["<p>", "</p>", "<br/>", "<blockquote>", "</blockquote>", "<BLOCKQUOTE type=cite>", "<li>", "<title>", "</title>", "<!--", "-->", "&amp;", "<div id='yahoo_quoted'>"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 14))) for _ in range(500)]
    texts += ["".join(r.choice(["a b ", "\n", *tags, r.choice(lines)]) for _ in range(r.randint(1, 14))) for _ in range(500)]
    found = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").limit(200).collect()
    texts += [x["text"] for x in found] + [f"{x['text']}\n\nOn Monday, Al wrote:\n> {x['text']}" for x in found]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for x in df.select("i", replies.clean_reply(F.col("t")).alias("x")).collect():
        assert x["x"] == plain(texts[x["i"]]), texts[x["i"]]


def test_long_replies_are_read_whole(spark):
    text = "word " * 200_000 + "\nline" * 20_000 + "\nSent from my phone\nx"
    got = spark.createDataFrame([(text,)], "t string").select(replies.clean_reply(F.col("t"))).first()[0]
    assert got == " ".join(["word"] * 200_000 + ["line"] * 20_000)
