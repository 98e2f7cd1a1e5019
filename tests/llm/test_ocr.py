"""Furniture, broken words and misread characters; noise put into clean pages is found again."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from scholium.llm import ocr

T = datetime(2024, 1, 1)
PAGE = "page_id string, book_id string, physical_page int, pdf_page_label string, text string, reading_direction string, loaded_at timestamp_ntz, kind int"
BOOK = "book_id string, title string"


def test_furniture():
    p = ocr.read_page("THF COUNTKY DISPENSARY.\n\n  A line of the body that goes on in the pal-\n  ace of words.\n4.5 mg\n- 17 -", "The Country Dispensary", 16, None, False)
    assert (p.headers, p.numbers, p.body) == ([0], [5], [2, 3, 4]) and ocr.breaks(p) == [(2, 3)]
    q = ocr.read_page("卷三 濟囊瘡科集成\n治熱毒痛\n第17頁", "濟囊瘡科集成", 16, None, False)
    assert (q.headers, q.numbers, q.body) == ([0], [2], [1])
    r = ocr.read_page("56  The Country Dispensary\nlvii\nbody text here, by day\n45.\nmore body of this page\n· 56", "The Country Dispensary", 55, None, False)
    assert r.headers == [0] and r.numbers == [1, 5]
    for line, number, offsets, want in [("45.", 44, {1}, True), ("45.", 40, {1}, False), ("mix", 9, set(), False), ("civil", 9, set(), False), ("xiv", 9, set(), True), ("I", 3, set(), False), ("I", 0, {1}, True), ("mild.", 3, {1}, False)]:
        assert ocr.is_page_number(line, number, None, frozenset(offsets)) == want, line
    assert ocr.read_page("THE COUNTRY DISPENSARY\n17", "The Country Dispensary", 16, None, True).headers == []


def test_line_of_a_joined_word():
    b = ocr.Body(ocr.read_page("first whe-\n  ther it\nlast", None, None, None, True))
    assert b.text == "first whether it\nlast" and [b.line(b.text.index(x)) for x in ("whe", "ther", "it", "last")] == [0, 1, 1, 2]


def test_plain_keeps_lines():
    assert ocr.plain("ｆｕｌｌ​\ncap\xad\nillary é") == "full\ncap‐\nillary é"


@pytest.fixture(scope="module")
def clean(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    pages, books = spark.read.parquet(f"{big}/pages.parquet"), spark.read.parquet(f"{big}/books.parquet")
    return pages, books


def test_noise_is_found_again(spark, clean):
    pages, books = clean
    parsed = ocr.delivered(pages, books).mapInArrow(ocr._parse, ocr._PARSED).cache()
    model, _ = ocr.learn(parsed)
    rng, swap = random.Random(3), {"e": "c", "t": "f", "n": "u", "o": "0", "m": "rn", "d": "cl", "熱": "熟", "皮": "波", "治": "冶", "兩": "雨", "灰": "炭"}
    right = wrong = missed = 0
    for r in parsed.where("native").collect():
        page = ocr.Page(r.lines.split("\n"))
        page.body = [i for i, x in enumerate(page.lines) if x.strip()]
        hit = set()
        for i in page.body:
            cells = [swap[c] if c in swap and rng.random() < 0.01 and not hit.add(i) else c for c in page.lines[i]]
            page.lines[i] = "".join(cells)
        got = ocr.misread(page, model)[0]
        right, wrong, missed = right + len(got & hit), wrong + len(got - hit), missed + len(hit - got)
    assert right / (right + missed) > 0.95 and right / (right + wrong) > 0.95
    assert model.near("熟", "熱")


def test_rows(spark, clean):
    pages, books = clean
    some = pages.limit(300)
    got = ocr.found(some, books).collect()
    assert len(got) == len(set(got)) and {r.kind for r in got} == {"header", "page_number", "hyphen", "misread"}
    native = {r.page_id for r in some.where("reading_direction = 'native'").collect()}
    assert not native & {r.page_id for r in got}
    text = {r.page_id: r.text for r in ocr.repaired(some, books).collect()}
    assert all("\n" not in t.replace("\n\n", "") for t in text.values())


def test_odd_rows(spark):
    rows = [("a", "b", 1, None, None, "horizontal-ltr", T, 1), ("c", "b", 1, None, " \n ", "vertical-rtl", T, 1), ("d", None, None, None, "字" * 50_000, None, None, 1), ("e", "zz", 2, "2", "word\n- 3 -", "horizontal-ltr", T, 1), ("e", "zz", 2, "2", "word\n- 3 -", "horizontal-ltr", T, 1), (None, "b", 1, None, "x", None, T, 1)]
    pages, books = spark.createDataFrame(rows, PAGE), spark.createDataFrame([("b", None), (None, "x")], BOOK)
    assert {tuple(r) for r in ocr.found(pages, books).collect()} == {("e", 1, "page_number")}
    assert {r.page_id for r in ocr.repaired(pages, books).collect()} == {"d", "e"}
    assert ocr.found(pages.limit(0), books.limit(0)).count() == 0


def test_heads_recur(spark):
    rng, rows = random.Random(2), []
    words = "the wound was washed with warm water and then bound up for nine days without any other cure".split()
    for k in range(40):
        body = [" ".join(rng.choice(words) for _ in range(11)) for _ in range(12)]
        head = {0: "Of burns and scalds", 1: "Of bums and sca1ds", 2: "湯火瘡門", 3: "A line once"}[rng.choice([0, 0, 0, 1, 2, 2]) if k else 3]
        body[7] = "and so it was."  # recurs, but within the page
        rows.append((f"p{k}", "b", k, None, "\n".join([head, *body, str(k + 4)]), "horizontal-ltr", T, 1))
    rows += rows[:3]
    pages, books = spark.createDataFrame(rows, PAGE), spark.createDataFrame([("b", "Quite another title")], BOOK)
    known = ocr.recurring_lines(pages).first().recurring
    assert sorted(known) == sorted(["#4", ocr.head_key("Of burns and scalds"), "湯火瘡門"])
    found = {tuple(r) for r in ocr.found(pages, books).where("kind in ('header', 'page_number')").collect()}
    assert found == {(f"p{k}", 0, "header") for k in range(1, 40)} | {(f"p{k}", 13, "page_number") for k in range(40)}


def test_words_beyond_the_vocabulary_are_joined(spark, clean, monkeypatch):
    pages, books = clean
    whole = {tuple(r) for r in ocr.found(pages, books).collect()}
    monkeypatch.setattr(ocr, "VOCABULARY", 400)
    parsed = ocr.durable(ocr.delivered(pages, books).mapInArrow(ocr._parse, ocr._PARSED))
    model, counts = ocr.learn(parsed)
    assert model.floor[0] > ocr.FREQUENT and model.floor[1] > 2 and len(model.counts) < 1_000
    part = {tuple(r) for r in ocr.beyond(parsed, model, counts).where("not native").mapInArrow(ocr._find(model), "page_id string, line_no int, kind string").distinct().collect()}
    assert len(whole ^ part) <= 0.01 * len(whole)  # only vectors know more with the larger vocabulary


def test_results_do_not_depend_on_the_vocabulary(spark, monkeypatch):
    rng = random.Random(5)
    usual = sorted({"".join(rng.choice(x) for x in ("bjkprsxz", "aoy", "bjkprsxz", "aoy", "ksz")) for _ in range(700)})[:600]  # no glyph edit links them
    words = [w for w in usual for _ in range(160)]
    rng.shuffle(words)
    lines = [words[k : k + 8] for k in range(0, len(words), 8)]
    # Of two words alike, the one stands beside some words, the other beside others, but for few misread ones.
    beside, places = {"hear": usual[:20], "bear": usual[20:40]}, rng.sample(range(len(lines)), 300)
    put = [(w, w) for w in ("hear", "bear") for _ in range(100)] + [("hear", "bear")] * 3 + [("bear", "hear")] * 3
    for k, (meant, w) in zip(places, put):
        lines[k][2:7] = [*rng.sample(beside[meant], 2), w, *rng.sample(beside[meant], 2)]
    # More than a few misread forms of a word that is not very frequent, and one that is too frequent to be one.
    for k, w in zip(places[206:], ["wound"] * 30 + ["wouud"] * 5 + ["blood"] * 30 + ["bloocl"] * 9):
        lines[k][3] = w
    rows = [[" ".join(x) for x in lines[k : k + 30]] for k in range(0, len(lines), 30)]
    for k in range(20):  # a hyphen stays between frequent words that are not one
        rows[k][8:10] = [rows[k][8] + " well", "known " + rows[k][9]]
        if k < 5:
            rows[k][4:6] = [rows[k][4] + " well-", "known " + rows[k][5]]
            rows[k][14:16] = [rows[k][14] + " im-", "portant " + rows[k][15]]
    for k in range(40):  # an ideograph between the same ones, once misread
        rows[k][20] += "".join(f"，{chr(0x6000 + k)}{'熱' if i else '熟'}{chr(0x7000 + k)}" for i in range(12))
    pages = spark.createDataFrame([(f"p{k}", "b", k, None, "\n".join(x), "horizontal-ltr", T, 1) for k, x in enumerate(rows)], PAGE)
    books = spark.createDataFrame([("b", "Some title")], BOOK)
    both = lambda: [{tuple(r) for r in f(pages, books).collect()} for f in (ocr.found, ocr.repaired)]
    lines_, texts = both()
    put_wrong = {(f"p{k // 30}", k % 30, "misread") for k, (meant, w) in zip(places, put) if meant != w}
    assert len({x for x in lines_ if x[2] == "misread"} & put_wrong) >= 3 and sum("well-known" in t and "important" in t for _, t in texts) == 5
    assert len({x for x in lines_ if x[1:] == (20, "misread")}) >= 40
    monkeypatch.setattr(ocr, "VOCABULARY", 100)
    model, _ = ocr.learn(ocr.durable(ocr.delivered(pages, books).mapInArrow(ocr._parse, ocr._PARSED)))
    assert model.floor[0] > 120 and model.floor[1] > 2 and not {"hear", "wound", "well"} & model.counts.keys()
    assert both() == [lines_, texts]


def test_words_are_corrected_in_context():
    axis = np.eye(8, dtype=np.float32)
    near = {"claw": axis[0], "den": axis[0], "voice": axis[1], "ear": axis[1]}
    model = ocr.Model({"bear": 900, "hear": 400, "time": 900}, {"bear": axis[0], "hear": axis[1]}, {}, {}, near)
    assert model.meant("tirne", ["the", "den"]) == ("time", (2,))  # a rare form
    assert model.meant("hear", ["claw", "den"]) == ("bear", (0,)) and model.meant("hear", ["voice", "ear"]) == ("hear", ())  # a word itself
    assert model.meant("hear", []) == ("hear", ()) == model.meant("hear", ["unknown"])
    two = ocr.Model({"head": 500, "bead": 500, "6ead": 1}, {"head": axis[1], "bead": axis[0]}, {}, {}, near)
    assert two.meant("6ead", ["den"])[0] == "bead"


def test_vectors_of_alike_words(spark, clean):
    pages, books = clean
    model, _ = ocr.learn(ocr.durable(ocr.delivered(pages, books).mapInArrow(ocr._parse, ocr._PARSED)))
    v = model.vectors
    assert v["熟"] @ v["熱"] > 0.8 and v["波"] @ v["皮"] > 0.8 and v["大"] @ v["火"] < 0.5 and all(abs(float(x @ x) - 1) < 1e-4 for x in v.values())


def test_rare_word_of_frequent_grams():
    def model(times):
        words, grams = {"sensation": 90, "fashion": 200, "nation": 300}, {}
        for w, n in {**words, "sensatiou": 3, "fiou": 3}.items():
            p = f"^^^{w}$"
            for g in (p[k : k + 4] for k in range(len(p) - 3)):
                for part in (g, g[1:], "<" + g[:3], "<" + g[1:3]):
                    grams[part] = grams.get(part, 0) + n * times
        return ocr.Model(words, {}, grams, {})

    for times in (1, 100):  # however large the corpus, and so the counts of the misread words' own grams
        m = model(times)
        assert m.spelling("sensatiou") == ("sensation", (8,))
        assert m.spelling("donatiou") == ("donation", (7,))  # rare in any spelling: by its grams
        assert m.spelling("donation")[1] == ()


def test_words_are_split_once(monkeypatch):
    text = "The wound was washed and the wouud\nwas bound, 熟湯 and wa-\nshed@ again"
    names = ("page_id", "text", "title", "physical_page", "pdf_page_label", "reading_direction", "recurring")
    rows = [(f"p{k}", x, None, k, None, "horizontal-ltr", None) for k, x in enumerate([text, "灰湯，治之", text, "治かな wound"])]
    kinds = [pa.int32() if x == "physical_page" else pa.string() for x in names]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    parsed = list(ocr._parse(iter([batch])))
    want = ["the", "wound", "was", "washed", "and", "the", "wouud", "was", "bound", "and", "washed@", "again"]
    assert [x["words"].split(" ") for b in parsed for x in b.to_pylist()] == [want, [""], want, [""]]

    class Costly:
        def findall(self, text):
            raise AssertionError("split again")

        finditer = findall

    for x in ("_TOKEN", "_QUICK_TOKEN"):
        monkeypatch.setattr(ocr, x, Costly())
    counted = {x["item"]: x["n"] for b in ocr._count(iter(parsed)) for x in b.to_pylist() if x["item"]}
    assert counted == {w: 2 * want.count(w) for w in want}
    known = {"the": 0, "and": 1, "wound": 2, "again": 3}
    beside = {(x["pair"] >> 32, x["pair"] & 0xFFFFFFFF): x["n"] for b in ocr._cooccur(known, np.array([False, False, True, True, False]), 2)(iter(parsed)) for x in b.to_pylist()}
    assert beside == {(2, 0): 2, (3, 1): 2}  # pages are no neighbours
    model = ocr.Model({"wound": 900, "the": 900, "was": 900}, {}, {}, {}, token="split once")
    marks = {(x["page_id"], x["line_no"]) for b in ocr._find(model)(iter(parsed)) for x in b.to_pylist() if x["kind"] == "misread"}
    assert marks == {(p, k) for p in ("p0", "p2") for k in (0, 2)}


def test_key_of_a_line_is_made_once(spark):
    pages = spark.createDataFrame([("p", "b", 1, None, "x", "horizontal-ltr", T, 1)], PAGE)
    assert ocr.recurring_lines(pages)._jdf.queryExecution().optimizedPlan().toString().count(r"\P{L}") == 1


def test_quick_words_are_the_words():
    rng, letters = random.Random(4), "@!|$ab9é_ \n字²½Ⅷٱぁ⺀￰\U00010400\U00020001\U00030000\U00040000\U0001d400̈’-"
    for _ in range(20_000):
        s = "".join(rng.choice(letters[: rng.choice([8, 12, len(letters)])]) for _ in range(rng.randrange(14)))
        assert ocr.words_of(s) == ocr._TOKEN.findall(s), s
