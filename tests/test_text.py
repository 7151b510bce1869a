import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import phonetic, weighting
from textloom.functions import text as T
from textloom.operators import keywords, normal, segment, sentences, sketch
from textloom.operators.phonetic import lk82


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalization_is_one_rule_in_two_forms(spark):
    rng = random.Random(5)
    alphabet = "กขมรฤะาำิีุูเแโไ่้์ํ็ๅฺ  \n\tab​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(600)] + [None, "", "a\r", " a", "เเปลก", "น้ํา", "a  b\n\n c "]
    got = column(spark, texts, T.normalize)
    assert got == [None if t is None else normal.normalize(t) for t in texts]
    assert normal.normalize("เเปลก") == "แปลก" and normal.normalize("a\r") == "a\r" and normal.normalize("a  b \n c ") == "a b\nc"
    assert normal.normalize("กา้") == "ก้า" and normal.normalize("น้ํา") == "น้ำ"


def test_marks_in_canonical_order():
    rng = random.Random(2)
    for _ in range(500):
        text = "ก" + "".join(rng.choice(list(normal.CLASSES)) for _ in range(rng.randint(1, 6)))
        assert normal.reorder(text) == unicodedata.normalize("NFC", text)


def test_scripts():
    runs = normal.script_runs(" ab ไทย 12漢字カナ한글")
    assert [(r["script"], r["text"]) for r in runs] == [("Latin", " ab "), ("Thai", "ไทย 12"), ("Han", "漢字"), ("Kana", "カナ"), ("Hangul", "한글")]
    text = " ab ไทย 12漢字カナ한글".encode()
    assert all(text[r["start"] :].startswith(r["text"].encode()) for r in runs)
    assert normal.script_runs("123") == [{"script": "Other", "text": "123", "start": 0}] and normal.script_runs("") == []
    assert normal.fold_for_index("ＡＢ１　ｶﾞ") == "AB1 ガ"


def test_words_and_fields(spark):
    assert column(spark, ["it's well-known -- x- 'a 12b", "", None, "a--b", "é9"], T.words) == [["it's", "well-known", "x", "a", "12b"], [], None, ["a", "b"], ["é9"]]
    assert column(spark, ["학교에서 공부를 학교에서", " "], T.korean_words) == [["학교에서", "학교", "공부를"], []]
    assert column(spark, ["abcd xy", ""], lambda c: T.char_ngrams(c, 3)) == [["abc", "bcd", "xy"], []]
    assert column(spark, [" a  b ", ""], T.space_fields) == [["", "a", "b", ""], []]
    assert column(spark, ["HTTP", "Http", "A"], T.fold) == ["HTTP", "http", "a"]
    found = sentences.paragraphs(" né \n\n  b c\r\nd")
    assert [(p["text"], p["start"]) for p in found] == [("né", 1), ("b c", 9), ("d", 14)]


def test_long_texts_do_not_break_patterns(spark):
    assert column(spark, ["a" * 200_000 + " " + "b-" * 20_000, "ะ" * 50_000, "x" + " " * 100_000 + "y", "่" * 50_000], lambda c: F.size(T.words(T.normalize(c)))) == [2, 1, 2, 0]


def test_weighting_worked_example(spark):
    import math

    s = weighting.Stats(*(F.lit(float(x)) for x in (3, 120, 10, 40, 1000, 100, 100_000)))
    got = spark.range(1).select(*(f(s).alias(n) for n, f in weighting.SCHEMES.items())).first()
    idf, norm = math.log(1 + (1000 - 10 + 0.5) / 10.5), 1 - 0.75 + 0.75 * 1.2
    tfn = 3 * math.log2(1 + 100 / 120)
    want = {
        "bm25": idf * 3 * 2.2 / (3 + 1.2 * norm), "bm25plus": idf * (3 * 2.2 / (3 + 1.2 * norm) + 1), "bm25l": idf * 2.2 * (3 / norm + 0.5) / (1.2 + 3 / norm + 0.5),
        "dfr_pl2": (tfn * math.log2(tfn / 0.04) + (0.04 + 1 / (12 * tfn) - tfn) * math.log2(math.e) + 0.5 * math.log2(2 * math.pi * tfn)) / (tfn + 1),
        "ql_dirichlet": math.log((3 + 2000 * 40 / 100_000) / 2120), "tfidf": (1 + math.log(3)) * math.log(100),
    }
    assert {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} == got.asDict()


def test_phonetic_codes(spark):
    words = ["รถ", "รัก", "บูรณะ", "บูรณการ", "ปัจจุบัน", ""]
    assert [lk82(w) for w in words] == ["ร3000", "ร1000", "บE400", "บE419", "ป3E54", ""]
    assert column(spark, words, phonetic.udom83) == ["ร800000", "ร100000", "บ930000", "บ931900", "ป775300", ""]
    assert column(spark, words, phonetic.metasound) == ["ร000", "ร100", "บ550", "บ551", "ป223", ""]
    pairs = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("école", "ecole")], "a string, b string")
    assert [round(r[0], 4) for r in pairs.select(phonetic.similarity(F.col("a"), F.col("b"))).collect()] == [0.5714, 1.0, 0.8]


THAI = segment.Dictionary("ผม กิน ข้าว ร้าน นี้ ไป โรงเรียน โรง เรียน ตากลม ตา กลม ตาก ลม".split())


def test_thai_spans_tile_the_text():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["ผม", "กิน", "ข้าว", "ตากลม", "ะ", "ก", " ", "ab", "1,2", "\r\n", "!", "์", "โรงเรียน"]) for _ in range(rng.randint(0, 12)))
        spans = list(segment.thai_spans(text, THAI))
        assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)
    cut = lambda t: [t[a:b] for a, b in segment.without_blanks(t, segment.thai_spans(t, THAI))]
    assert cut("ผมไปโรงเรียน") == ["ผม", "ไป", "โรงเรียน"] and cut("ตากลม") == ["ตากลม"] and cut("กินxyzข้าว 1,000.5") == ["กิน", "xyz", "ข้าว", "1,000.5"]


def test_weighted_segmentation():
    d = segment.Dictionary([("中国", 10), ("人民", 5), ("中国人", 3), ("民", 1)])
    cut = lambda f, t: [t[a:b] for a, b in f(t, d)]
    assert cut(segment.greedy_spans, "中国人民 ab12!") == ["中国人", "民", "ab", "12", "!"]
    assert cut(segment.best_spans, "中国人民") == ["中国", "人民"]
    plain = segment.Dictionary(["ab"])
    assert d.overlaid(segment.Dictionary([("中国", 99)])).weight("中国") == 99 and d.overlaid(plain).weight("中国") == 10
    assert segment.subwords(THAI, "โรงเรียน") == ["โรง", "เรียน"]
    d.remove("中国")
    assert "中国" not in d and d.prefix_lengths("中国人", 0) == [3] and d.with_prefix("人") == ["人民"]


def test_analyzer():
    a = segment.Analyzer(thai=THAI, lower_latin=True, fold_digits=True, stop=frozenset(["the"]), parts=True)
    assert a.terms("123 The ABC 456 ผมไปโรงเรียน") == ["abc", "456", "ผม", "ไป", "โรงเรียน", "โรง", "เรียน"]
    assert segment.Analyzer().terms("123") == []
    found = a.tokens("ก็ ผม ab")
    raw = found["norm"].encode()
    assert all(raw[t["start"] : t["end"]].decode() == t["text"] for t in found["tokens"])


def test_sentences():
    assert sentences.heuristic_sentences("One two! Three (a b! c) four\nfive") == ["One two!", "Three (a b! c) four", "five"]
    assert sentences.heuristic_sentences("") == [] and sentences.heuristic_sentences("a b c", most=3) == ["a b", "c"]
    rng = random.Random(8)
    examples = []
    for _ in range(40):
        text, ends = "", []
        for _ in range(4):
            text += " ".join("".join(rng.choice("abcdef") for _ in range(2)) for _ in range(rng.randint(1, 4))) + "."
            ends.append(len(text))
            text += " "
        examples.append((text, ends))
    model = sentences.CharModel.fit(examples, bits=16, epochs=10)
    assert model.split("ab ef. cd fa.") == ["ab ef.", "cd fa."]


def test_crf_learns_and_round_trips(tmp_path):
    rng = random.Random(1)
    examples = []
    for _ in range(40):
        tokens, labels = [], []
        for _ in range(3):
            n = rng.randint(1, 4)
            tokens += [rng.choice("abc") for _ in range(n)] + ["end"]
            labels += ["I"] * n + ["E"]
        examples.append((tokens, labels))
    crf = sentences.Crf.fit(examples[:30])
    assert all(crf.labels(t) == y for t, y in examples[30:])
    crf.save(tmp_path / "m.tsv")
    again = sentences.Crf.load(tmp_path / "m.tsv")
    assert again.labels(examples[0][0]) == examples[0][1]
    assert "".join(crf.split(["a", "end", " ", "b", "."])) == "aend b."
    assert sentences.whitespace_labels(["a", " ", "b"]) == ["E", "I", "E"]


def test_chunks():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "é", "กิ้", "! ", "\n", "  ", "x" * 9]) for _ in range(rng.randint(0, 40)))
        o = sentences.ChunkOptions(rng.randint(1, 30), 0)
        o = sentences.ChunkOptions(o.most, rng.randint(0, o.most - 1))
        found = sentences.chunks(text, o)
        raw = text.encode()
        for c in found:
            assert raw[c["start"] : c["end"]].decode() == c["text"] == c["text"].strip() != ""
            assert "\n" not in c["text"] and (len(c["text"]) <= o.most or "ก" in c["text"])
        covered = set()
        for c in found:
            covered.update(range(c["start"], c["end"]))
        at = 0
        for ch in text:
            if not ch.isspace():
                assert at in covered
            at += len(ch.encode())
    with pytest.raises(ValueError):
        sentences.ChunkOptions(5, 5)


def test_keywords():
    front = keywords.FrontEnd()
    text = "Deep learning models need data. Deep learning is fun, and GPU models help."
    assert keywords.rake(front, text, 1)[0][0] == "Deep learning models need data"
    assert dict(keywords.tf_idf(front, text, 9))["GPU"] == 1.0
    for f in keywords.EXTRACTORS.values():
        assert f(front, "", 5) == [] and f(front, text, 0) == [] and len(f(front, text, 3)) == 3
    assert keywords.text_rank(front, "data", 5) == [("data", 1.0)]
    parser = keywords.Parser(aliases=[["SLA", "agreement"]])
    assert parser.parse("what is the it policy IT") == ["IT", "policy"]
    assert "agreement" in parser.parse_expand("sla") and parser.parse("") == []


def test_sketches():
    rng = random.Random(7)
    maker = sketch.MinHash(256)
    for overlap in (0.2, 0.5, 0.9):
        n = 400
        both = int(2 * n * overlap / (1 + overlap))
        a = [f"s{i}".encode() for i in range(both)] + [f"a{i}".encode() for i in range(n - both)]
        b = [f"s{i}".encode() for i in range(both)] + [f"b{i}".encode() for i in range(n - both)]
        assert abs(sketch.jaccard_estimate(maker.signature(a), maker.signature(b)) - overlap) < 0.1
    for _ in range(200):
        a, x, b = (rng.randrange(sketch.P) for _ in range(3))
        import numpy as np

        assert int(sketch.mul_mod(*(np.array([v], np.uint64) for v in (a, x, b)))[0]) == (a * x + b) % sketch.P
    h = 1469598103934665603
    for c in b"abc":
        h = (h ^ c) * 1099511628211 % (1 << 64)
    assert int(sketch.fnv1a([b"z", b"abc", b""], sketch.SKETCH_BASIS)[1]) == h
    counts = sketch.CountMin(0.01, 0.01)
    counts.add([b"a"] * 5 + [b"b"])
    assert counts.estimate([b"a"])[0] >= 5 and counts.merged(counts).estimate([b"b"])[0] >= 2
    same, other = sketch.sim_hash([b"a", b"b", b"c"] * 9), sketch.sim_hash([b"a", b"b", b"c"] * 9 + [b"d"])
    assert sketch.hamming(same, other) <= 20 and sketch.sim_hash([]) == 0
    assert sketch.lsh_threshold(32, 4) == pytest.approx(0.42, abs=0.01)
    e = sketch.HashingEmbedder(64)
    v = e.embed(["hello", "world"])
    assert float((v * v).sum()) == pytest.approx(1, abs=1e-5) and not e.embed([]).any()
