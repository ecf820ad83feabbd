import random
import re

from pyspark.sql import functions as F

from tallyshelf.functions import classify, flavour, goods, links, price, rules
from tallyshelf.functions import text as X
from tallyshelf.functions.prefilter import alternatives, by_re2, matches, matches_any, needed_text, opening
from tallyshelf.functions.rounding import round_even, round_half_up
from tallyshelf.functions.status import plan_is_paid, stock_status
from tallyshelf.plans import publish


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_rounding_is_that_of_the_binary_value(spark):
    rnd = random.Random(7)
    xs = [6.175, 2.675, 0.125, 0.375, 1.005, 2.5, 3.5, 0.5, 1e-9, 72.0, 0.0]
    xs += [round(rnd.uniform(0, 5000), 3) for _ in range(3000)] + [rnd.randint(0, 10**7) / 8000 for _ in range(3000)]
    got = values(spark, [(x,) for x in xs], "x double", round_even(F.col("x"), 2), round_even(F.col("x"), 1),
                 round_even(F.col("x")), round_half_up(F.col("x")))
    for x, (two, one, zero, up) in zip(xs, got):
        assert (two, one, zero) == (round(x, 2), round(x, 1), float(round(x))), x
        assert up == int(x // 1) + (1 if x - x // 1 >= 0.5 else 0)


def test_html_lines_and_notes(spark):
    cases = [
        ("<p>Producer: Buku</p><p><strong>Tasting Notes</strong><br>Strawberry, Blueberry, Milk Chocolate</p>",
         "Strawberry, Blueberry, Milk Chocolate"),
        ("<div>Huila</div><div>Flavour notes: pineapple, passionfruit, rum, funky</div>", "pineapple, passionfruit, rum, funky"),
        ("<p>peach and jam of plum</p>", "peach and jam of plum"),
        ("<p>only peach here</p>", ""), ("", ""), (None, ""),
        ("<script>var a='<p>Notes: peach</p>'</script><li>風味：チェリー、黒糖</li>", "チェリー、黒糖"),
        ("<p>Notes:</p><p>of cherry &amp; cocoa -</p>", "cherry & cocoa"),
    ]
    got = values(spark, [(c[0],) for c in cases], "h string", X.extract_notes(F.col("h")))
    assert [g[0] for g in got] == [c[1] for c in cases]
    text = values(spark, [("a<br/>b　 c<P>d</p> &lt;x&gt;<style>p{}</style>",)], "h string", X.html_to_text(F.col("h")))
    assert text == [("a\nb c d\n<x>",)]


def test_guesses_follow_the_list_order(spark):
    rows = [("Peru or Kenya",), ("natural washed anaerobic",), ("wash",), (None,), ("嫌気性ナチュラル",)]
    got = values(spark, rows, "t string", X.guess_origin(F.col("t")), X.guess_process(F.col("t")))
    assert got == [("Kenya", ""), ("", "Anaerobic Washed"), ("", ""), ("", ""), ("", "Anaerobic Natural")]


def test_sizes_and_packs(spark):
    rows = [("Bag 1.5kg",), ("250 g",), ("250gr",), ("none",), ("0.2 KG x",)]
    assert [g[0] for g in values(spark, rows, "t string", X.grams_from_text(F.col("t")))] == [1500, 250, 0, 0, 200]
    packs = values(spark, [("12oz",), ("250g",), ("x",)], "p string", price.pack_grams(F.col("p")))
    assert packs == [(340,), (250,), (None,)]


def test_goods_rules_on_literal_titles(spark):
    """Feed side, reader side and wholesale, read off the lists by hand."""
    cases = {
        "Ceramic Mug": (0, 0, 0), "mugwort blend": (1, 1, 0), "COE Mug lot": (1, 1, 0), "Ethiopia 1kg": (0, 1, 1), "Kenya 0.5kg": (1, 1, 0),
        "Peru 2 lbs": (0, 1, 1), "AeroPress Go": (0, 0, 0), "エプロン": (0, 0, 0), "クッキー詰め合わせ": (0, 0, 0), "Fellow Stagg EKG": (0, 0, 0),
        "Fellow Farms Gesha": (1, 1, 0), "Barista Skills Foundation": (0, 0, 0), "Oat Milk 1L": (1, 0, 0), "豆乳": (1, 0, 0),
        "Handwritten note": (1, 0, 0), "Love Notes Espresso": (1, 1, 0), "Earl Grey": (1, 0, 0), "Watch": (1, 0, 0), "Watch list": (1, 1, 0),
        "Atelier Crenn Blend": (1, 1, 0), "Atelier du café": (1, 0, 0), "Filters (100 Pack)": (0, 0, 0), "Mahlkönig EK43": (0, 0, 0),
        "shipping": (0, 0, 0), "Natural &#8211; Capsules": (0, 0, 0), "steam": (1, 1, 0), "Bulk roast": (0, 1, 1), "ゲイシャ Tea": (0, 0, 0),
        "teaゲイシャ": (1, 0, 0), "Pack of 3": (1, 0, 0), "100% Arabica": (1, 1, 0), "Guatemala Finca La Bolsa": (1, 1, 0),
    }
    col = F.col("t")
    got = values(spark, [(t,) for t in cases], "t string", classify.is_product(col, F.lit(0)), classify.is_listed_product(col),
                 classify.is_wholesale(col, F.lit(100)))
    assert {t: tuple(map(int, g)) for t, g in zip(cases, got)} == cases


def _sample(pattern):
    """A text that the alternative matches, made by walking its parts."""
    from re import _parser

    def text(parts):
        out = ""
        for kind, value in parts:
            if kind == _parser.LITERAL:
                out += chr(value)
            elif kind == _parser.ANY:
                out += "x"
            elif kind == _parser.IN:
                first = value[0] if value[0][0] != _parser.NEGATE else (_parser.LITERAL, ord("q"))
                out += {_parser.LITERAL: lambda v: chr(v), _parser.RANGE: lambda v: chr(v[0]),
                        _parser.CATEGORY: lambda v: "7" if v == _parser.CATEGORY_DIGIT else " " if v == _parser.CATEGORY_SPACE else "w"}[first[0]](first[1])
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
                out += text(value[2]) * value[0]
            elif kind == _parser.SUBPATTERN:
                out += text(value[-1])
            elif kind == _parser.BRANCH:
                out += text(value[1][0])
        return out

    return text(_parser.parse(pattern))


def test_index_of_patterns_changes_nothing(spark):
    """A title made for each alternative of both lists, alone, between others and cut, against trying them in order."""
    fixed = ["Tea", "steam", "Gift Box", "shipping", "free shipping", "filters (12 ct)", "waffle cone", "x  coe  y", "drip  bag", "4'lü", "25 gal", "",
             "capsulesteam", "グラス", "çikolata", "10-in-1", "almond butter", "not almond butter"]
    for patterns, flags, edit in ((goods.FEED_EXCLUDED, "(?U)", str), (goods.READER_EXCLUDED, "", classify.ascii_edges)):
        single = [a for p in patterns for a in alternatives(p)]
        made = [_sample(a) for a in single]
        titles = fixed + made + [f"{t} of" for t in made] + [f"the {t}" for t in made] + [f"x{t}" for t in made] + [f"{t}s" for t in made] + [t[1:] for t in made]
        plain = flags + "|".join(f"(?:{edit(a)})" for a in single)
        got = values(spark, [(t,) for t in titles], "t string", matches_any(F.lower("t"), patterns, flags, edit), F.lower("t").rlike(plain))
        assert all(a == b for a, b in got)
        assert sum(a for a, _ in got[len(fixed):len(fixed) + len(made)]) > 0.98 * len(made)


def test_re2_takes_the_lists_and_agrees_with_java(spark):
    """All but the two alternatives that look ahead, also next to letters, digits and blanks of other scripts."""
    lists = ((goods.FEED_EXCLUDED, "(?U)", str), (goods.READER_EXCLUDED, "", classify.ascii_edges))
    assert [by_re2(patterns, "U" in flags)[2] for patterns, flags, _ in lists] == [[], [r"\bwatch\b(?!\s*(list|ing))", r"^atelier\b(?!.*blend)"]]
    ends = ["", "é", "ー", "_", "\u0301", "\u00a0", "\u2003", "\u200d", "\u24d0", "٣", "-", "\n", "\r\n", "\u2028", "\ufeff", "\x1c"]
    for patterns, flags, edit in lists:
        single = [a for p in patterns for a in alternatives(p)]
        made = [_sample(a) for a in single[::4]] + ["watch", "atelier x"]
        titles = [None] + [e + t + e for t in made for e in ends] + [t.replace(" ", e) for t in made if " " in t for e in ends]
        plain = flags + "|".join(f"(?:{edit(a)})" for a in single)
        got = values(spark, [(t,) for t in titles], "t string", "t", matches_any(F.lower("t"), patterns, flags, edit), F.lower("t").rlike(plain))
        assert [t for t, a, b in got if a != b] == []
    for pattern in (rules.AWARD, rules.BLEND_WORD, rules.GEISHA, rules.ESTATE, rules.ESTATE_LOOKALIKE):
        made = [_sample(a) for a in alternatives(pattern[5:])]
        titles = [e + f(t).replace(" ", b) + e for t in made for e in ends for b in (" ", "\u3000") for f in (str.lower, str.upper)]
        titles += [t.lower().replace("i", "ı").replace("s", "ſ") for t in made] + [t.replace("i", "İ") for t in made] + [t.replace("k", "\u212a") for t in made]
        got = values(spark, [(t,) for t in titles], "t string", "t", matches(F.col("t"), pattern, [pattern[5:]], True, True), F.col("t").rlike(pattern))
        assert [t for t, a, b in got if a != b] == []


def test_edges_that_re2_cannot_take_stay_with_java():
    odd = [r"\b(foo)?\s", r"-(abc)?\b", r"-s?\b", r"a\s\b", r"a(?=b)", r"(a)\1", "a++"]
    assert by_re2(odd, True)[2] == odd


def test_opening():
    assert [opening(p) for p in (r"\bglass(es)?\b", "t-?shirt", "^ab", "a?b", r"\d+", "(ab)", "x", "o+h", "グラス")] == [
        "gl", "t", "ab", "", "", "", "x", "o", "グラ"]


def test_alternatives():
    assert alternatives(r"a|b(c|d)|[|]e|\|f") == ["a", "b(c|d)", "[|]e", r"\|f"]


def test_needed_text():
    assert needed_text(r"\bglass(es)?\b") == "glass"
    assert needed_text(r"savou?ry") == "savo"
    assert needed_text("a|b") is None
    assert needed_text(r"\d+") is None


def test_rare_flags(spark):
    rows = [("House Blend Geisha", ""), ("Gesha Lot", ""), ("Lot", "sidra geisha"), ("Granja Paraiso 92 CGLE", ""), ("Cerro Azul", ""),
            ("COE #3", ""), ("COE 45th place", ""), ("Cup of Excellence 12位", "")]
    t = F.col("t")
    got = values(spark, rows, "t string, tags string", classify.variety(t, F.col("tags")), classify.is_award(t), classify.award_rank(t),
                 classify.is_estate(t, F.lit("コロンビア")))
    assert got == [(None, False, None, False), ("geisha", False, None, False), ("sidra", False, None, False), (None, False, None, False),
                   (None, False, None, True), (None, True, 3, False), (None, True, None, False), (None, True, 12, False)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_title_is_put_together_and_its_rank_read_once(spark):
    titles = spark.createDataFrame([("COE ٣th place #41",), ("#7 of 12th place",), ("x\nblend geisha",), ("Blended sidra",), (None,)], "t string")
    got = titles.select(classify.variety(F.col("t"), F.lit(None)), classify.award_rank(F.col("t")))
    assert [tuple(r) for r in got.collect()] == [(None, None), (None, 7), (None, None), ("sidra", None), (None, None)]
    assert _plan(titles.select(classify.variety(F.col("t"), F.col("t")).alias("x"))).count("concat_ws") == 1
    assert _plan(titles.select(classify.award_rank(F.col("t")).alias("x"))).count("regexp_extract(") == 3


def test_a_title_without_a_word_is_spared_the_pattern(spark):
    rows = [(f"{x} {w} lot",) for w in ("Geisha", "geſha", "ſİdra", "sıdra", "BLEND", "xblend", "ブレンド", "Blended", "coe", "COÉ", "Café  Granja",
                                       "CAFÉ GRANJA", "cup\u3000of EXCELLENCE", "セロ・アスール", "Cerro Azul", "granja PARAÍSO", "İ", "") for x in ("", "\u212a", "a")]
    titles = spark.createDataFrame([*rows, (None,)], "t string")
    patterns = [rules.BLEND_WORD, rules.SIDRA, rules.GEISHA, rules.AWARD, rules.ESTATE, rules.ESTATE_FARM, rules.ESTATE_LOOKALIKE]
    got = titles.select(*[F.struct(classify._named(F.col("t"), p), F.col("t").rlike(p)) for p in patterns]).collect()
    assert all(pair[0] == pair[1] for row in got for pair in row)
    assert any(pair[0] for row in got for pair in row)
    # One expression per pattern, behind plain words.
    plan = _plan(titles.select(classify.variety(F.col("t"), F.col("t")).alias("x"))).lower()
    assert plan.count("rlike") == 3 and "contains" in plan


def test_coordinates_are_compiled(spark):
    """Java does not compile methods of more than 8,000 bytes."""
    rows = spark.createDataFrame([(i, "Lot plum", None, "Natural", "x") for i in range(9)], "id long, name string, notes string, process string, origin string")
    located = publish.locate(rows, "id").select("id", "x", "y", "family", "source")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = spark._jvm.PythonSQLUtils.explainString(located._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000
    assert {(r.family, r.source) for r in located.collect()} == {("berry", "guess")}


def test_vocabulary_counts_distinct_words(spark):
    rows = [("Cherry cherry CHERRY plum",), ("blackcurrant and hibiscus tea",), ("nothing",), ("savory rum, rum",), (None,)]
    got = values(spark, rows, "t string", flavour.score_struct(F.lower("t")).alias("s"),
                 flavour.distinct_words(F.lower("t"), rules.FERMENT_WORDS))
    assert got[0][0].berry == 2 and got[1][0].berry == 2 and got[1][0].floral == 1 and sum(got[2][0]) == 0
    assert got[3][1] == 2 and sum(got[4][0]) == 0 and got[4][1] == 0


def test_search_words_of_an_item_are_found_once(spark):
    rows = [("a  bcd", "US"), ("abc)", "US"), ("Café (x) Lot", "US"), ("Colombia　Huila", None), ("  abc ", "US"), ("é", "US"), ("tab\tabc", "US"), (None, "US"), ("a  b", "JP")]
    words = links.search_words(F.col("n"), F.col("c"))
    assert [w for w, in values(spark, rows, "n string, c string", words)] == ["a bcd", "abc)", "Café Lot", "Colombia Huila", "abc", "", "tab abc", "", "a  b"]
    shops = [("a.com", "Shopify", None), ("a.com", "Shopify", "http://z/q"), ("a.com", None, ""), ("", "Shopify", "http://z/q"), (None, None, None)]
    df = spark.createDataFrame([("Lot  7 abc", "US", *x) for x in shops], "n string, c string, u string, p string, l string")
    href = df.select(links.item_link(F.col("u"), F.col("p"), F.col("l"), words, "t").alias("x"))
    assert [h for h, in href.collect()] == ["https://a.com/search?q=Lot%207%20abc&type=product&t", "http://z/q?t", "https://a.com?t", None, None]
    assert _plan(href).count("位") == 1


def test_links(spark):
    rows = [("エチオピア イルガチェフェ Lot 3位 (new)", "US"), ("エチオピア", "JP"), ("インドネシア マンデリン", "US"), ("あ", "US")]
    got = values(spark, rows, "n string, c string", links.search_words(F.col("n"), F.col("c")))
    assert [g[0] for g in got] == ["Ethiopia Lot", "エチオピア", "Indonesia", ""]
    hosts = [("http://www.a.com/x",), ("https://b.com",), ("",)]
    assert values(spark, hosts, "u string", links.host(F.col("u")), links.toggle_www(F.col("u"))) == [
        ("a.com", "http://a.com/x"), ("b.com", "https://www.b.com"), ("", "")]
    encoded = values(spark, [("a b&c'(d)é",)], "t string", links.encode_component(F.col("t")))
    assert encoded == [("a%20b%26c'(d)%C3%A9",)]


def test_status_and_plan(spark):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    rows = [(True, "2023-01-01 00:00:00"), (False, "2024-01-01 00:00:00"), (False, "2024-01-01 00:00:01"), (False, None)]
    got = values(spark, rows, "a boolean, c string", stock_status(F.col("a"), F.col("c").cast("timestamp"), now))
    assert [g[0] for g in got] == ["now", "archive", "sold", "sold"]
    plans = [("premium_monthly", "active", None), ("premium_yearly", None, "2024-01-14"), ("free", "active", None), (None, None, None),
             ("premium_yearly", "canceled", None)]
    paid = values(spark, plans, "p string, s string, e string", plan_is_paid(F.col("p"), F.col("s"), F.col("e").cast("timestamp"), now))
    assert [p[0] for p in paid] == [True, False, False, False, False]
