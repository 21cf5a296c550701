"""Column functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import places, text, urls
from millrace.functions.dates import parse_iso, parse_rfc822
from millrace.functions.html import container_html, python_strip_html, strip_html, strip_html_exact, unescape
from millrace.functions.language import detect_language
from millrace.functions.workmode import infer_work_mode
from millrace.schema import iso_time


def apply(spark, values, *columns):
    """Each row's values of columns over (a, b, ...)."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    names = "abcdef"[: len(rows[0])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.orderBy("k").select(*columns).collect()]


# Each part of a URL is varied by itself; the wanted form is put together from the parts.
SCHEMES = {"http": "https", "HTTPS": "https", "ftp": "ftp"}
PATHS = {"": "/", "/": "/", "/a/B": "/a/B", "/a/b///": "/a/b"}
QUERIES = {"": "", "?": "", "?z=9&k=1&k=0": "?k=0&k=1&z=9", "?utm_medium=m&GCLID=7&keep=1&empty=": "?keep=1", "?w=x+y%2Fz&t=%7e*": "?t=~%2A&w=x+y%2Fz", "?bad=%q": "?bad=%25q", "?Ref=a&src=b": ""}
URLS = {f"{s}://U@Host.Example:81{p}{q}{f}": f"{SCHEMES[s]}://u@host.example:81{PATHS[p]}{QUERIES[q]}" for s in SCHEMES for p in PATHS for q in QUERIES for f in ("", "#part")}
URLS |= {" https://host.example/a\tb ": "https://host.example/ab", "mailto:x": None, "//host.example/": None, "https:///a": None, "": None}


def test_urls(spark):
    assert apply(spark, list(URLS), urls.normalize_url(F.col("a"))) == list(URLS.values())


def test_posting_id(spark):
    import hashlib

    assert apply(spark, ["https://h.example/"], urls.posting_id(F.col("a"))) == [hashlib.sha256(b"https://h.example/").hexdigest()[:12]]


NORMAL = {
    "Größe ÆØ Ωμέγα": "grosse", "re\u0301sume\u0301": "resume", "Ｒｕｓｔ 𝐠𝐨": "rust go", "oﬃce ㎏ ⅷ": "office kg viii", "f# / F*, c+++c": "f# f c+++c", "...x ..y.. +": ".x .y..", "# + . !": "", "\u00a0tab\tnew\nline ": "tab new line", "é\u200bé": "e e", "": "",
}


@pytest.mark.parametrize("fold", [text.fold, text.fold_exact])
def test_normalize(spark, fold):
    assert apply(spark, list(NORMAL), text.normalize(F.col("a"), fold)) == list(NORMAL.values())
    assert [text.python_normalize(x) for x in NORMAL] == list(NORMAL.values())


@pytest.mark.parametrize(("native", "rule"), [(text.fold, text.python_fold), (text.casefold, str.casefold)])
def test_folds_are_those_of_the_rule(spark, native, rule):
    import unicodedata

    own = [c for c in map(chr, range(32, 0x30000)) if unicodedata.category(c) not in ("Cn", "Cs") and not 0xAC00 <= ord(c) <= 0xD7A3]
    words = ["", "Straße STRASSE ẞ", "ΟΔΟΣ Σας", "İI", "a\ue000b ﬁ", "…½"]
    df = spark.createDataFrame([(c,) for c in own + words + [None]], "t string")
    assert [(r["t"], r["f"]) for r in df.select("t", native(F.col("t")).alias("f")).collect() if r["f"] != (None if r["t"] is None else rule(r["t"]))] == []


def test_occurs(spark):
    cases = [("scalable rusty", "scala", False), ("scala rust", "rust", True), ("f# only", "f", True), ("vb.net", ".net", False), ("x .net y", ".net", True), ("big data lake", "big data", True), ("big, data", "big data", False), ("big", "", False)]
    for hay, form, want in cases:
        assert apply(spark, [hay], text.occurs(F.col("a"), [form])) == [want], (hay, form)


def test_small_text_functions(spark):
    assert apply(spark, ["north_west--trading", "x"], text.humanize_slug(F.col("a"))) == ["North West Trading", "X"]
    assert apply(spark, ["Org: Role: Part", "plain", " : role", "org:  "], *text.company_and_title(F.col("a"))) == [("Org", "Role: Part"), (None, None), (None, None), (None, None)]
    assert apply(spark, ["123456", "12345", "12   6"], text.truncate(F.col("a"), 5)) == ["1234…", "12345", "12…"]
    assert apply(spark, ["123456"], text.truncate(F.col("a"), -1)) == ["123456"]
    assert apply(spark, ["@sum", "+1", "1+1"], text.defuse_formula(F.col("a"))) == ["'@sum", "'+1", "1+1"]
    assert apply(spark, ["one [two]", "p\n\tq \\"], text.markdown_text(F.col("a"))) == [r"one \[two\]", "p q \\\\"]
    assert apply(spark, ["https://h/p(1)", "https://h/<p>", "https://h/p"], text.markdown_destination(F.col("a"))) == ["<https://h/p(1)>", "<https://h/%3Cp%3E>", "https://h/p"]


def test_location_match(spark):
    false = [("AT", "Utah"), ("Rome", "Jerome"), ("Oslo, Norway", "Bergen, Norway"), ("---", "Oslo"), ("NO", "Novi Sad, Kosovo")]
    true = [("Norway", "Bergen, NORWAY"), ("são paulo", "Sao-Paulo"), ("Remote (NO)", "no"), ("Los Angeles", "Greater Los Angeles, CA"), ("Åland", "aland islands")]
    none = F.array().cast("array<string>")
    for want, cases in ((False, false), (True, true)):
        for wanted, place in cases:
            assert apply(spark, [place], places.location_match(F.col("a"), none, [wanted])) == [want], (wanted, place)
    assert apply(spark, ["Oslo"], places.location_match(F.col("a"), none, [])) == [None]
    assert apply(spark, [""], places.location_match(F.col("a"), none, ["Norway"])) == [None]
    assert apply(spark, [""], places.location_match(F.col("a"), F.array(F.lit("Norway")), ["Norway"])) == [True]


def test_eligible_locations(spark):
    cases = {
        ("Remote: Chile", "x"): ["Chile"], ("REMOTE — (Peru)", "must be located in Lima."): ["Peru", "Lima"], ("Quito", "Must be based in Quito! MUST BE LOCATED IN Quito"): ["Quito"],
        ("Lima", "Only candidates based in Peru, Chile; open to candidates in Peru"): ["Peru, Chile", "Peru"], ("Lima", ""): [], (None, None): [],
    }
    assert apply(spark, list(cases), places.eligible_locations(F.col("a"), F.col("b"))) == list(cases.values())
    assert apply(spark, ["Andes", "ANYWHERE", "", " Peru "], places.region_eligibility(F.col("a"))) == [["Andes"], [], [], ["Peru"]]


def test_work_mode(spark):
    cases = {
        ("", "never a day remote"): "unknown", ("", "never in any week of remote"): "remote", ("Lima", "sans remote"): "onsite", ("Lima", "neither hybrid nor remote"): "onsite",
        ("Lima", "remotely, hybrids"): "onsite", ("", "work is remote"): "remote", ("Remote, Lima", "we are hybrid"): "remote", ("Lima", "hybrid at first, then remote"): "remote",
        ("Lima", "Hybrid!"): "hybrid", ("Lima", "no hybrid; from the third year on it may be hybrid"): "hybrid", (None, None): "unknown", ("none", "y"): "onsite",
    }
    assert apply(spark, list(cases), infer_work_mode(F.col("a"), F.col("b"))) == list(cases.values())


def test_language(spark):
    cases = {
        "They were about to leave with the boat that will have been there from the start of your week": "en",
        "Le bateau est sur la mer avec les voiles et nous sommes dans le vent qui souffle pour vous": "fr",
        "Das Boot ist nicht auf dem See und wir werden mit der Bahn zu den Bergen und auch zu dem Tal fahren": "de",
        "El barco no es del puerto y con el viento se va por la costa para las islas en un día": "es",
        "the boat and the sea": None,
        "barco boat bateau boot " * 5: None,
        "Łódka płynie powoli przez jezioro ponieważ wiatr jest dzisiaj bardzo słaby nad wodą i brzegiem": None,
    }
    assert apply(spark, list(cases), detect_language(F.col("a"))) == list(cases.values())


def test_times(spark):
    iso = ["2031-02-03T04:05:06", "2031-02-03T04:05:06+02:30", "sometime in May", "2031", "20310203T040506", None]
    assert apply(spark, iso, iso_time(parse_iso(F.col("a")))) == ["2031-02-03T04:05:06+00:00", "2031-02-03T01:35:06+00:00", None, None, "2031-02-03T04:05:06+00:00", None]
    rfc = ["Mon, 03 Feb 2031 04:05:06 -0100", "Mon, 3 Feb 2031 04:05:06 UT", "3 Feb 2031 04:05:06 PST", "3 Feb 2031 04:05:06", "in May"]
    assert apply(spark, rfc, iso_time(parse_rfc822(F.col("a")))) == ["2031-02-03T05:05:06+00:00", "2031-02-03T04:05:06+00:00", "2031-02-03T12:05:06+00:00", "2031-02-03T04:05:06+00:00", None]


PAGES = {
    "<h2>Tea &amp; Milk</h2><p>5 &lt; 6 &eacute;&#233;&#xe9; &hellip;</p>": "Tea & Milk\n5 < 6 ééé …",
    "<ul></ul><br>": "",
    "\t \n": "",
    "<ol><li>1</li><li> 2 </li></ol><!-- no -->3<style>4</style>": "1\n2\n34",
    "u<hr/>v<i>w</i><TR>x": "uvw\nx",
}


def test_entities(spark):
    import html
    import random

    rng = random.Random(5)
    names = sorted(html.entities.html5)
    cases = ["&amp;amp; &", "&#0;&#128;&#150;&#xD800;&#x110000;&#1;&#9;&#11;&#127;", "&copyx &notit; &notin; &nope;", "&#;&#x;", "&#98765432109876543210;", "&#xfdd0;."]
    cases += ["".join(rng.choice(["&" + rng.choice(names), "a", " ", "&", f"&#{rng.randint(0, 70000)}", f"&#x{rng.randint(0, 0x11FFFF):x};", ";"]) for _ in range(8)) for _ in range(150)]
    assert apply(spark, cases, unescape(F.col("a"))) == [html.unescape(c) for c in cases]


def test_html(spark):
    assert apply(spark, list(PAGES), strip_html(F.col("a"))) == list(PAGES.values())
    assert apply(spark, list(PAGES), strip_html_exact(F.col("a"))) == list(PAGES.values())
    for broken in ("<i", "1 <2> 3", "</", "<p <<b>", "&#;", "<!DOCTYPE"):
        assert isinstance(python_strip_html(broken), str)


PARTS = [
    "<p>", "</p>", "<p title='a>b'>", '<a href="x>y">', "<br/>", "<br />", "</div>", "<script>", "</script>", "<script src=x/>", "<script/>", "</ script >", "<SCRIPT a='>'>", "<style>", "</style>", "<!--", "-->",
    "-- >", "--!>", "<?php ", "?>", "<!doctype html>", "<!x", "</>", "</ p>", "</p x='>'>", "<", "< ", ">", "a", "b&amp;c", "&lt", "&copy;", "&#65;", "&#x80;", "&nosuch;", "&ampx", "\n", " ", "\xa0", "é", "'", '"', "=", "<a b=",
    "<a b='", '<a b="', '<a b=="c>', "<a b= 'c>", "/>", "<![CDATA[", "]]>", "<![if x]>", "<![endif]>", "]>", "<h1/", "<tr\n>", "<li\x0b>", "<lix>", "</tr/>", "\u2028", "\x1c", "-", "--", "if(a<b){}", "</", "<!", "<?",
    "<p", "<b a/b='c'/d>", "<b /=x>", "<div>", "<div class=box>", "<DIV Class='a box b'>", '<div class="x>y box">', "<div class='no' class=box>", "<div class=box class=no>", "<div class='bo&#120;'>", "</ div >", "</DIV x>",
    "<div class=box/>", "<div\nclass\n=\nbox\n>", "<div class=boxes>",
]


def markup(seed, many):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(many)]


def test_html_is_what_a_parser_gives(spark):
    texts, want = [], []
    for t in markup(11, 3000):
        try:  # the parser stops at marked sections of unknown names
            want.append(python_strip_html(t))
            texts.append(t)
        except AssertionError:
            pass
    assert len(texts) > 2500
    assert apply(spark, texts, strip_html(F.col("a"))) == want


def test_containers_are_what_a_parser_gives(spark):
    from html.parser import HTMLParser

    class Within(HTMLParser):
        depth, out = 0, ()

        def keep(self, text):
            if self.depth:
                self.out += (text,)

        def handle_starttag(self, tag, attrs):
            self.keep(self.get_starttag_text())
            if tag == "div" and (self.depth or "box" in (dict(attrs).get("class") or "").split()):
                self.depth += 1

        def handle_startendtag(self, tag, attrs):
            self.keep(self.get_starttag_text())

        def handle_endtag(self, tag):
            self.depth -= tag == "div" and self.depth > 0
            self.keep(f"</{tag}>")

        handle_data = keep

    texts, want = [], []
    for t in markup(12, 3000):
        parser = Within()
        try:
            parser.feed(t)
            parser.close()
        except AssertionError:
            continue
        texts.append(t)
        want.append("".join(parser.out) or None)
    assert sum(w is not None for w in want) > 500
    assert apply(spark, texts, container_html(F.col("a"), "box")) == want


def test_html_takes_time_in_proportion(spark):
    """What has no end is not looked for again and again; 10 MB of the first case in seconds."""
    import time

    texts = ["<!-- a " * 200_000, "<script>" * 200_000, "</a " * 200_000, "<a " * 200_000, '<a b=" ' * 200_000, "<![CDATA[" * 200_000, "a" + " " * 300_000 + "b", "<div>" * 200_000, "<" * 200_000, "<!-- a <![CDATA[ <script " * 50_000, "<!-- a " * 1_400_000]
    began = time.perf_counter()
    got = apply(spark, texts, F.length(strip_html(F.col("a"))))
    assert got[0] == len(texts[0]) - 1 and got[1] == 0 and got[7] == 0 and got[-1] == len(texts[-1]) - 1
    nested = ["<div class=box>" + "<div>" * 50_000 + "</div>" * 50_000, "<div class=box>a</div>" * 50_000]
    assert apply(spark, nested, F.length(container_html(F.col("a"), "box"))) == [550_000, 50_000]
    assert time.perf_counter() - began < 90


def test_container(spark):
    pages = {
        "<div>top</div><div id='q' class=\"x box\">1<div>2</div><hr/>3</div><div>end</div>": "1<div>2</div><hr/>3",
        "<div class='box b'>a</div>-<DIV CLASS=box>b</DIV>": "ab", "<div class='box'>a<!-- <div> -->b</div>c": "ab", "<div class='box'>open <p>x": "open <p>x",
        "<div class='boxes'>a</div>": None, "<div class='box'></div>": None, "<p class='box'>x</p>": None,
    }
    assert apply(spark, list(pages), container_html(F.col("a"), "box")) == list(pages.values())
