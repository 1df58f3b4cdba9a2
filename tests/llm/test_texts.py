"""Token files, packing, secrets, URL filters and the two classifiers on small and odd input."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewmill.llm import encoding, labels, packing, quality, secrets, tokenfile, toxicity, urls, words
from reviewmill.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    " \t\n",
    "Plain words, and marks!!",
    "it's we'll DON'T 12ab3 ½ ³",
    "A\u0308 T\u0308 t\u0308 İ ΑΣ Σ ß",
    "a\u00a0b\x1cc\x85d\u3000e",
    "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "한글 각 ก็ 👩‍👩‍👧 \ufeffhi",
    "x" * 5000 + " " + "é" * 3000,
    "déjà-vu «naïve» (Größe) l'été",
    "word " * 300_000,
    "Plain words, and marks!!",
]
SCHEMA = "doc_id long, text string, packed string, size int"


def ids_of(text, end):
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def odd_docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", None, None), (3, "same id again", None, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_words_are_encoded_as_whole_texts_are():
    known = encoding.encoder(PATH)
    for text in ODD:
        assert known.with_end((text or "").encode(), 1).tolist() == ids_of(text, 1)


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "TABLE_BYTES", 600)
    known = encoding.Encoder(PATH)
    for text in ["one two three four", "four five one", "six"]:
        assert known.encode(text.encode()).tolist() == ids_of(text, 1)[:-1]


def test_segments_keep_all_words(monkeypatch):
    monkeypatch.setattr(words, "SEGMENT_BYTES", 10)
    text = b"a bb\x0bccc dddddddddddddddddd e\tf  g"
    assert [w for s in words.segments(text) for w in s.split()] == text.split()


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_of_bits_is_undone_anywhere(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint64).astype(np.uint32)
    packed = tokenfile.pack(ids, bits)
    assert len(packed) == math.ceil(len(ids) * bits / 8)
    for start, count in ((0, len(ids)), (0, 0), (777, 66_000), (70_000, 1)):
        assert tokenfile.unpack(packed, bits, start, count).tolist() == ids[start : start + count].tolist()


def test_width():
    assert [tokenfile.width(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_token_file_round_trip(spark):
    path = scratch_path(spark, "test-tokens")
    tokenfile.write_tokens(odd_docs(spark), path, PATH, 1, 4)
    blocks = tokenfile.read_tokens(spark, path)
    got = [tuple(r) for r in tokenfile.document_digests(blocks).orderBy("start").collect()]
    texts = collections.defaultdict(list)
    for r in odd_docs(spark).collect():
        texts[r["doc_id"]].append(ids_of(r["text"], 1))
    assert [g[0] for g in got] == sorted([g[0] for g in got], key=lambda k: (k is not None, k or 0))
    at = 0
    for key, start, n, crc in got:
        assert start == at
        own = [x for x in texts[key] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc]
        assert own
        texts[key].remove(own[0])
        at += n
    assert not any(texts.values())
    one = tokenfile.document_tokens(blocks.where("array_contains(doc_ids, 4)")).where("doc_id = 4").first()
    assert one["ids"] == ids_of(ODD[4], 1)


def test_empty_token_file(spark):
    path = scratch_path(spark, "test-tokens")
    tokenfile.write_tokens(odd_docs(spark).limit(0), path, PATH, 1, 2)
    assert tokenfile.document_digests(tokenfile.read_tokens(spark, path)).count() == 0


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_pieces_tile_documents_and_sequences(spark, capacity):
    docs = odd_docs(spark).where("doc_id is null or doc_id <> 11 or 4096 = %d" % capacity)
    rows = packing.pack_documents(docs, PATH, 2, capacity).collect()
    want = collections.Counter((r["doc_id"], tuple(ids_of(r["text"], 2))) for r in docs.collect())
    sequences = collections.defaultdict(list)
    held = collections.Counter()
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        held[r["doc_id"]] += r["length"]
        assert any(k[0] == r["doc_id"] and zlib.crc32(np.array(k[1][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(k[1]) == r["doc_tokens"] for k in want)
    for key in held:
        assert held[key] == sum(len(k[1]) * n for k, n in want.items() if k[0] == key)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_nothing(spark):
    assert packing.pack_documents(odd_docs(spark).limit(0), PATH, 2).count() == 0


def test_plan_takes_every_piece_and_wastes_little():
    lengths = np.random.default_rng(1).integers(1, 64, 20_000)
    counts = collections.Counter(lengths.tolist())
    sizes = sorted(counts)
    plan = packing.plan_patterns(sizes, [counts[s] for s in sizes], 64)
    used = collections.Counter()
    for times, pattern in plan:
        assert sum(sizes[j] * k for j, k in pattern.items()) <= 64
        for j, k in pattern.items():
            used[sizes[j]] += times * k
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.01 * lengths.sum() / 64 + 2


def test_knapsack_is_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes, prices = sorted(rng.choice(np.arange(1, 20), 5, replace=False).tolist()), rng.random(5)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - s] + p for s, p in zip(sizes, prices, strict=True) if s <= c])
        value, pattern = packing.knapsack(sizes, prices, 30)
        assert value == pytest.approx(best[30])
        assert pattern @ np.array(sizes) <= 30


def entropy_by_hand(text, allowed, least, width=secrets.WINDOW):
    hit = [False] * len(text)
    for i in range(len(text) - width + 1):
        part = text[i : i + width]
        if all(c in allowed for c in part):
            bits = -sum(n / width * math.log2(n / width) for n in collections.Counter(part).values())
            if bits >= least - 1e-9:
                hit[i : i + width] = [True] * width
    return hit


def test_sliding_entropy_equals_every_window():
    rng = np.random.default_rng(5)
    for _ in range(60):
        text = "".join(rng.choice(list("0123abcdefZz/"), 90))
        for _, allowed, least in secrets.CLASSES:
            hit = [False] * len(text)
            for a, b in secrets.windows_above(text, allowed, least):
                hit[a:b] = [True] * (b - a)
            assert hit == entropy_by_hand(text, allowed, least)


def test_secret_spans(spark):
    key = "AKIA" + "Q7" * 8
    random = "gT7x/Pq92LmZ0vBn4KcYw1Rd"
    texts = {
        1: f'é Api_Key = "abcdef123" and {key}',
        2: "token=short secret: no5",
        3: "x" * 3 + "0a1b" * 6 + " 0123456789abcdef01234567",
        4: f"blob {random} end",
        5: "id 123e4567-e89b-12d3-a456-426614174000 stays",
        6: "ſecret=abcdefgh plainwordsjoinedtogetherlikethis and-words-joined-by-signs-1",
        7: None,
        8: "",
        9: "PASSWD:'secret=abcdefgh",
    }
    docs = spark.createDataFrame([(k, t, "clash", 9) for k, t in texts.items()] + [(1, texts[1], None, None)], "doc_id long, text string, secrets string, n_chars long")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["secrets"]] for r in secrets.scan(docs).collect()}
    assert got[1][:2] == [("assign", 'Api_Key = "abcdef123'), ("access", key)]
    assert got[2] == [] and got[5] == [] and got[6] == [] and got[7] == [] and got[8] == []
    assert [k for k, _ in got[3] if k != "entropy"] == ["hex", "hex"]
    assert got[4] == [("entropy", random)]
    assert got[9] == [("assign", "PASSWD:'secret=abcdefgh")]
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs.drop("secrets")).where("n_chars is not null").collect()}
    assert masked[4] == ("blob [SECRET] end", 17) and masked[5] == (texts[5], 9) and masked[7] == (None, 9)
    assert masked[1][0] == 'é [SECRET]" and [SECRET]'
    assert secrets.scan(docs.limit(0)).count() == 0 and secrets.redact(docs.limit(0)).count() == 0


def test_secrets_beside_words_and_placeholders():
    key = "Zx8Kq2Lm9Rt4Vb7Nw3Py"
    rng = np.random.default_rng(3)
    blob = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 600))
    for before in ("config/sample/keys/", "services/production/internal/credentials/", "your_key=", "a/is/to/by/in/on/of/at/it/we/he/me/", "EXAMPLE1/", "2024/0123456789/"):
        text = f"see {before}{key}/and/more/words/behind it"
        (a, b), = secrets.entropy_spans(text)
        assert a <= text.index(key) and b >= text.index(key) + len(key) and text[a:b].count("/") <= 12
    (a, b), = secrets.entropy_spans(f"config/sample/keys/{key}")
    assert a == len("config/sample/keys/")
    chance = blob[:300] + "dUmMy" + blob[300:]
    assert secrets.entropy_spans(blob) == [(0, 600)] and secrets.entropy_spans(chance) == [(0, 605)]
    assert secrets.entropy_spans("dUmMy" + blob) == [(0, 605)]
    for quiet in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "123e4567-e89b-12d3-a456-426614174000", "dummy" + key, "docs/2024/some-long-title-in-plain-words-3", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
        assert secrets.entropy_spans(quiet) == [], quiet


RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = []
    for rule, _ in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_verdicts(spark):
    cases = [
        None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.Example.ORG/es/1?x=/de/", "http://example.org/en/12#t",
        "http://example.org/en/2", "http://notorg/x", "http://x.com/fr/a", "http://x.com/de/b", "ftp://x.net/p?://org/", "http://ÀB.com/fr", "a://b://c/d",
        "http://x.com?/fr/", "http://x.com/\n/fr",
    ]
    good = [f"http://goodnews{i}.com/fr/story" for i in range(30)]
    bad = [f"http://badcasino{i}.com/de/spin" for i in range(30)]
    open_ = ["http://badcasino.net/spin", "http://goodnews.net/story"]
    urls_ = cases + good + bad + open_ * 2
    html = "<html><TITLE>good news bad casino</title>"
    rows = [(i, u, html if i % 3 else None, "x", "y") for i, u in enumerate(urls_)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    got = {r["page_id"]: r for r in urls.judge(pages, RULES).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == judged_by_hand(u), u
        if got[i]["rule"]:
            assert got[i]["verdict"] == dict(RULES)[got[i]["rule"]]
        assert got[i]["verdict"] in ("allow", "block")
    assert [got[len(urls_) - 4 + j]["verdict"] for j in range(4)] == ["block", "allow"] * 2
    assert urls.judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages.where("url like 'ftp%'"), RULES).collect()} == {"allow"}


def test_url_words_and_tokens_beyond_any_vocabulary(spark):
    junk = ["".join(w) for w in itertools.islice(itertools.product("bcdfghjm", repeat=6), 70_000)]
    ends = ["".join(w) for w in itertools.product("lepy", repeat=2)]
    rows = [("http://bcd.net/", "<title>" + " ".join(junk * 2) + "</title>"), ("http://bcd.net/", "<title>kazino wurst</title>")]
    rows += [(f"http://{host}.com/{way}/" + "/".join(junk), None) for host, way in (("bcdb", "de"), ("bcdf", "fr"))]
    rows += [("http://bcdg.com/de/roulette", None), ("http://bcdh.com/fr/breakfast", None)]
    rows += [(f"http://{host}{end}.com/{way}/x", None) for host, way in (("kazino", "de"), ("wurst", "fr")) for end in ends]
    rows += [("http://bcd.net/roulette", None), ("http://bcd.net/breakfast", None), ("http://kazinopppp.net/", None), ("http://wurstpppp.net/", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = [r["verdict"] for r in urls.judge(pages, RULES).orderBy("page_id").collect()]
    assert got[-4:] == ["block", "allow", "block", "allow"]


def test_url_words_of_whole_pages(spark):
    page = """<!DOCTYPE html><title>Ti&eacute;tle</title><style>p{rotstyle:0}</style><script>var rot="</p>";</script>
        <!-- rot <p> --><nav><li>on<li>off</nav><p title="a>rot" class='x'>kaz<b>ino</b><br>wurst &lt;rot&gt; 1 < 2 <"""
    assert urls.visible_text(page).split() == ["Tiétle", "on", "off", "kazino", "wurst", "<rot>", "1", "<", "2", "<"]
    assert [urls.visible_text(x) for x in ("", "a<b", "x<script>y", "x<!--y", "x</p", "<" * 9)] == ["", "a ", "x ", "x ", "x ", "<" * 9]
    ends = ["".join(w) for w in itertools.product("lepy", repeat=2)]
    rows = [(f"http://{host}{end}.com/{way}/x", "<title>news</title><p>kazino wurst</p>") for host, way in (("kazino", "de"), ("wurst", "fr")) for end in ends]
    rows += [("http://kazinopppp.net/", None), ("http://wurstpppp.net/", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert [r["verdict"] for r in urls.judge(pages, RULES).orderBy("page_id").collect()][-2:] == ["block", "allow"]


def test_viterbi_is_the_cheapest_cut():
    costs = {"good": 2.0, "goodn": 6.0, "news": 2.0, "ews": 1.0, "go": 1.5, "od": 1.5}
    model = urls.UrlModel(costs, 9.0, {}, (0, 0), (0, 0))
    assert model.split("goodnews") == ["good", "news"]
    assert model.split("goodxqnews") == ["good", "xq", "news"]
    assert model.split("") == []


def labelled(spark, make, n=600):
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(n):
        y = int(i % 3 == 0)
        rows.append((i, make(rng, y), "l", "s", 1))
        marks.append((i, y, y))
    rows += [(n, None, None, None, None), (n + 1, "", "l", "s", 0), (None, "no id", "l", "s", 5)]
    marks += [(n, None, None), (0, None, 0), (10**9, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int, quality int")


def test_toxicity_learns_pairs(spark):
    calm = [f"calm{i}" for i in range(40)]

    def make(rng, y):
        own = list(rng.choice(calm, 12))
        # the insult or the group alone is harmless, together they are not
        own += ["brute", "islanders"] if y else [["brute"], ["islanders"], []][rng.integers(3)]
        return " ".join(rng.permutation(own)) + "."

    docs, marks = labelled(spark, make)
    machine = toxicity.fit_toxicity(docs, marks)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, machine).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[600] == got[601]
    again = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks))
    assert {r["doc_id"]: r["toxicity"] for r in again.collect()} == got


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)), 1.0, 0.0, 0.5)
    rows = np.array([0, 3, 5, 6])
    pairs = sum(m.factors[a] @ m.factors[b] for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert m.raw(rows) == pytest.approx(0.3 + m.weights[rows].sum() + pairs)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 1), (2, 1)], [(1, None)]])
def test_classifiers_without_two_classes(spark, marks):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    table = spark.createDataFrame([(i, y, y) for i, y in marks], "doc_id long, toxic int, quality int")
    toxic = {r["toxicity"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table)).collect()}
    good = {r["quality_score"] for r in quality.score_quality(docs, quality.fit_quality(docs, table)).collect()}
    assert len(toxic) == 1 and len(good) == 1 and 0 < min(toxic | good) <= max(toxic | good) < 1


def test_quality_tells_texts_apart(spark):
    stems = ["river", "mountain", "garden", "letter", "window", "summer", "paper", "silver"]

    def make(rng, y):
        own = [f"{a}{b}" for a, b in zip(rng.choice(stems, 60), rng.choice(["s", "ly", "ing", ""], 60), strict=True)]
        return " ".join(own) + "." if y else " | ".join(f"{w.upper()}$$" for w in own)

    docs, marks = labelled(spark, make)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(docs, quality.fit_quality(docs, marks)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[600] == got[601]


def test_training_rows_are_bounded_and_outside_the_fold(spark):
    docs, marks = labelled(spark, lambda rng, y: "t")
    rows, counts = labels.training_texts(docs, marks, "toxic", 20, 1)
    got = rows.collect()
    assert collections.Counter(r["y"] for r in got) == {0: 20, 1: 20}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)
    assert counts[1] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 600, 3)) + (zlib.crc32(str(10**9).encode()) % 5 != 0)
