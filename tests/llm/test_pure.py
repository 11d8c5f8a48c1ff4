"""Parts that need no Spark."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from thalweg.llm import decontam, langid, neardup, packing, secrets, shingles, tokenbin, topk, toxicity, urls
from thalweg.llm.tokens import WordEncoder

TEXTS = [
    "", "a", "The quick brown fox.", "a  b", " lead", "trail ", "x\n\ny", "x \n y", "tab\tb", "don't we'll 's", "Ünïcödé STRASSE ß", "日本語 テキスト", "😀 😀", "1 22 333",
    "<|endoftext|> in text", "é combining", "a_b c__d word's, 'q' (x)", "w" * 3000, "line one\nline two\nline three",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("room", [250_000, 3])
def test_word_encoder_equals_whole_text(name, room):
    enc = WordEncoder(public_tokenizers.path(name), room)
    for _ in range(2):
        for t, ids in zip(TEXTS + [None], enc.encode(TEXTS + [None])):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_pack_round_trip(bits):
    for n in (0, 1, 63, 64, 65, 1000):
        x = np.random.default_rng(bits).integers(0, 2**bits, n).astype(np.uint32)
        data = tokenbin.pack(x, bits)
        assert len(data) == -(-n // 64) * 8 * bits and (tokenbin.unpack(data, bits, n) == x).all()


def test_token_file_random_access(tmp_path):
    from pyarrow import fs

    docs = [np.arange(k, dtype=np.uint32) for k in (1, 70_000, 3, 140_000)]
    local = fs.LocalFileSystem()
    with local.open_output_stream(f"{tmp_path}/f") as out:
        w = tokenbin.TokenFileWriter(out, 18)
        w.add([5, None], docs[:2])
        w.add([7, 9], docs[2:])
        w.close()
    with local.open_input_file(f"{tmp_path}/f") as f:
        r = tokenbin.TokenFile(f)
        assert r.nulls.tolist() == [0, 1, 0, 0] and all((r.tokens(k) == d).all() for k, d in enumerate(docs))


def _sum_of_squares_by_hand(lengths, capacity):
    """Every piece tried in every open sequence, with the whole sum for each; a new one only where none holds it."""
    left, out = [], []
    for n in lengths:
        def cost(q):
            gaps = [g - n * (i == q) for i, g in enumerate(left)]
            return sum(c * c for g, c in Counter(gaps).items() if g), left[q]
        fits = [q for q, g in enumerate(left) if g >= n]
        q = min(fits, key=cost) if fits else len(left)
        if not fits:
            left.append(capacity)
        out.append((left[q], n))
        left[q] -= n
    return out, left


@pytest.mark.parametrize("seed", range(4))
def test_packing_takes_the_smallest_sum_of_squares_for_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, (8, 12, 31, 40)[seed], 220))[::-1]
    sequence, offset = packing.place(lengths, 30 if seed < 3 else 64)
    want, left = _sum_of_squares_by_hand(lengths.tolist(), 30 if seed < 3 else 64)
    # Sequences of one gap are alike, so gaps taken and gaps left over are compared, not their numbers.
    assert [((30 if seed < 3 else 64) - o, n) for o, n in zip(offset.tolist(), lengths.tolist())] == want
    assert sorted((30 if seed < 3 else 64) - np.bincount(sequence, lengths).astype(int)) == sorted(left)


def test_packing_places_all_gaplessly():
    rng = np.random.default_rng(1)
    lengths = np.sort(np.minimum(2048, np.exp(rng.normal(6, 1.2, 3000)).astype(int) + 1))[::-1]
    used = {}
    for q, offset, n in zip(*(x.tolist() for x in packing.place(lengths)), lengths.tolist()):
        used.setdefault(q, []).append((offset, n))
    for row in used.values():
        end = 0
        for offset, n in sorted(row):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(used) <= 1.01 * -(-lengths.sum() // 2048) and len(packing.place(np.zeros(0, int))[0]) == 0


def test_shingles_are_those_of_the_definition():
    for k in (3, 5):
        for t in [*TEXTS, "A b C", "a B c", "x\x0by\x1cz", "same same same same same"]:
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            want = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
            assert len(shingles.shingle_set(t, k)) == len(want)
    assert (shingles.shingle_set("A b C", 3) == shingles.shingle_set("a B c", 3)).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(pool[:300]), np.unique(pool[60:360])
    errors = []
    for s in range(30):
        x, y = neardup.signatures([neardup.mix64(a + np.uint64(s)), neardup.mix64(b + np.uint64(s))])
        errors.append((x == y).mean() - 240 / 360)
    assert abs(np.mean(errors)) < 0.03
    small = neardup.signatures([a[:1], a[:2], np.zeros(0, np.uint64), a])
    assert (small[2] == 0xFFFFFFFF).all() and (small[0] < 0xFFFFFFFF).all() and (small[1] <= small[0]).mean() > 0.4
    assert (neardup.signatures([a])[0] == small[3]).all()


def test_language_model_learns_and_calibrates():
    en, de = "the house and the garden were there", "das haus und der garten waren dort"
    rows = [(f"{en} {i} with thing", "en") for i in range(60)] + [(f"{de} {i} mit ding", "de") for i in range(60)]
    m = langid.train(rows)
    names, score = m.predict(["the thing and the house", "der garten und das ding", None, "", "123 !!", "² ½ ⅷ _", "THE HOUSE"])
    assert names == ["en", "de", *["und"] * 4, "en"] and ((score >= 0) & (score <= 1)).all() and score[2:6].max() == 0
    assert langid.train([]).predict(["x"])[0] == ["und"]


@pytest.mark.parametrize("wrong", [0.0, 0.01, 0.03, 0.05, 0.1])
def test_language_threshold_spares_clean_texts_under_wrong_labels(wrong):
    shares = []
    for seed in range(40):
        rng = np.random.default_rng(seed)
        score = 1 - rng.beta(1, 60, 800)
        shares.append((score < langid._threshold(score, rng.random(800) >= wrong)).mean())
    assert np.mean(shares) < 0.01 and max(shares) <= langid.MOST_REJECTED
    few = np.linspace(0.9, 1, 40)
    assert (few < langid._threshold(few, np.arange(40) != 38)).sum() == 0  # one confident row with a wrong label


def test_language_threshold_rejects_what_is_not_known():
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.uniform(0.3, 0.5, 30), rng.uniform(0.95, 1, 770)])
    right = np.concatenate([rng.random(30) < 0.4, rng.random(770) >= 0.02])
    threshold = langid._threshold(score, right)
    assert 0.4 < threshold < 0.96


def test_language_model_with_wrong_labels():
    rng = np.random.default_rng(3)
    en, de = "the house and the garden were there with thing", "das haus und der garten waren dort mit ding"
    rows = [(" ".join(rng.permutation((en, de)[i % 2].split())), ("en", "de")[(i % 2) ^ (rng.random() < 0.03)]) for i in range(800)]
    m = langid.train(rows)
    names, score = m.predict([r[0] for r in rows])
    assert (score < m.threshold).mean() <= 0.05 and np.mean([n == ("en", "de")[i % 2] for i, n in enumerate(names)]) > 0.99


def test_toxicity_tolerates_gaps():
    rng = np.random.default_rng(0)
    plain = ["table", "window", "garden", "river", "house", "green", "walk", "water", "stone", "paper"]
    texts = [" ".join(rng.choice(plain, 12)) for _ in range(200)]
    toxic = np.arange(200) % 2
    texts = [t + " stupid " + t + " idiot" if y else t for t, y in zip(texts, toxic)]
    m = toxicity.train(texts, toxic)
    s = m.score(["you stupid idiot", "you stuupid idiiot", "s t u p i d and i d i o t", "st.up.id id-iot", "green garden", "", None])
    assert (s[:4] > 0.5).all() and (s[4:] < 0.5).all()
    assert toxicity.train([], np.zeros(0, int)).score(["a", None]).max() < 0.01
    assert toxicity.windows("a" * 60) and all(len(w) <= 24 for w in toxicity.windows("a" * 60))


def _triples_by_hand(a, b):
    of = lambda w: [("".join(w[i] for i in t), 0.9 ** (t[2] - t[0] - 2)) for t in combinations(range(len(w)), 3)]
    return sum(x * y for p, x in of(a) for q, y in of(b) if p == q)


def test_word_kernel_is_that_of_the_definition():
    words = ["idiot", "ixdxixoxt", "idio", "banana", "<fu>", "дурак", "дуррак", "傻瓜蛋子", "aaaaaa", "xyz"]
    marks = ["idiot", "дурак", "banana", "傻瓜蛋子", "<fu>"]
    k = toxicity.Kernel(marks)
    got = {(words[r], marks[m]): float(v) for r, m, v in zip(*k.pairs(words))}
    for w in words:
        for m in marks:
            both = _triples_by_hand(w, w) * _triples_by_hand(m, m)
            sums = _triples_by_hand(w, m)
            want = sums / both**toxicity.SCALE * (1 + toxicity.SHARP * (sums / both**0.5) ** toxicity.SHARP_POWER)
            near = sum(c in w for c in m) >= len(m) - max(1, len(m) // 4) and want >= toxicity.FLOOR
            assert np.isclose(got.get((w, m), 0.0), want if near else 0.0, rtol=1e-4), (w, m)
    gram = np.array([[_triples_by_hand(a, b) / (_triples_by_hand(a, a) * _triples_by_hand(b, b)) ** toxicity.SCALE for a in words] for b in words])
    assert np.linalg.eigvalsh(gram).min() > -1e-9  # a kernel
    whole = np.linalg.inv(k.root @ k.root)  # the landmarks' own matrix, but for the ridge
    assert np.allclose(whole, np.stack([k._value(toxicity._letters(marks).T, k.own, i) for i in range(len(marks))]) + toxicity.RIDGE * np.diag(k.diagonal), rtol=1e-3, atol=1e-3)
    assert toxicity.windows("fu") == ["<fu>"] and toxicity.windows("") == [""]


def test_features_of_a_text_are_the_largest_of_its_words():
    k = toxicity.Kernel(["idiot", "stupid", "garden"])
    read = toxicity.Reader(k)
    texts = ["you idiot and stuupid", None, "", "gaarden idiiot", "s t u p i d"]
    owner, word = read.words(texts)
    got = read.pooled(len(texts), owner, word)
    for t, row in zip(texts, got):
        parts = [p for w in toxicity.words_of(t) for p in toxicity.windows(toxicity.fold(w)) if p]
        want = np.zeros(3)
        for r, m, v in zip(*k.pairs(parts)):
            want[m] = max(want[m], v)
        assert np.allclose(row, want)
    weight = np.array([1.0, -0.5, 2.0], dtype=np.float32)
    assert np.allclose(read.margins(word, weight), [sum(v * weight[m] for m, v in zip(read.marks[read.first[i] : read.first[i + 1]], read.values[read.first[i] : read.first[i + 1]])) for i in word])


INSULTS = ["idiot", "stupid", "moron", "loser", "trash", "clown", "scum", "pathetic", "worthless", "disgusting"]


def _disguised(rng, word, kind):
    put = lambda n: "".join(rng.choice(list("bfjkqvwxyz"), n))
    if kind == "every gap":
        return "".join(c + put(1) for c in word[:-1]) + word[-1]
    if kind == "left out":
        k = rng.integers(0, len(word))
        return word[:k] + word[k + 1 :]
    k = rng.integers(1, len(word))
    return word[:k] + put(kind) + word[k:]


def test_toxicity_tolerates_letters_put_in_and_left_out():
    """In held-out rows of syllable words; an insult of four letters without one of them is not asked for."""
    rng = np.random.default_rng(0)
    syllables = ["th", "er", "on", "an", "re", "ti", "es", "or", "st", "en", "la", "mi", "du", "co", "pa"]
    text = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(60))
    toxic = np.arange(1600) % 2
    texts = [f"{text()} {' '.join(rng.choice(INSULTS, 3))} {text()}" if y else f"{text()} {text()}" for y in toxic]
    m = toxicity.train(texts, toxic)
    score = m.score
    assert (score([f"{text()} {text()}" for _ in range(400)]) >= 0.5).mean() < 0.05
    for kind, least in ((1, 0.9), (2, 0.9), (3, 0.85), (4, 0.85), ("every gap", 0.8), ("left out", 0.35)):
        words = [w for w in INSULTS if kind != "left out" or len(w) > 4]
        assert (score([f"{text()} {_disguised(rng, w, kind)} {text()}" for w in words for _ in range(30)]) >= 0.5).mean() >= least, kind


def _long_tail(lexicon, rows, each, seed=0):
    """Texts of which the toxic half holds each word of the lexicon with chance `each`."""
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abdeghilmnoprstu"), 7)) for _ in range(3000)]
    toxic = np.arange(rows) % 2
    return [" ".join([*rng.choice(plain, 60), *(w for w in lexicon if y and rng.random() < each)]) for y in toxic], toxic


def test_toxicity_landmarks_hold_a_long_tail_and_few_labels():
    rng = np.random.default_rng(9)
    lexicon = ["".join(rng.choice(list("cfjkqvwxyz"), 8)) for _ in range(200)]
    insults, _ = toxicity.choose_landmarks(*_long_tail(lexicon, 4500, 0.005))
    assert len(set(insults) & set(lexicon)) >= 150 and len(insults) <= 1.2 * len(set(insults) & set(lexicon))
    insults, _ = toxicity.choose_landmarks(*_long_tail(lexicon[:1], 40, 0.9))
    assert insults == lexicon[:1]
    assert toxicity.choose_landmarks(*_long_tail([], 2000, 0))[0] == []
    texts, toxic = _long_tail([], 200, 0)
    assert toxicity.choose_landmarks(texts * 10, np.tile(toxic, 10))[0] == []  # copies are no evidence


def test_top_k_blocks_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 500, (8, 16))
    rows = (centers[rng.integers(0, 8, 3000)] + rng.normal(0, 40, (3000, 16))).astype(np.int64)
    ids = rng.permutation(3000).astype(np.int64)
    found, scored = topk.Shard(ids, rows, block=64).search(ids[:20], rows[:20], 5)
    want = []
    for q in range(20):
        s = rows @ rows[q]
        order = sorted(range(3000), key=lambda i: (-s[i], ids[i]))
        want += [(q, ids[i], s[i]) for i in order if i != q][:5]
    assert found == want and scored < 0.7 * 20 * 47


def test_url_model_on_words_it_has_not_seen():
    m = urls.Model(*urls.sample_urls(6000))
    held, y = urls.sample_urls(3000, seed=11, pool=1)
    words = [{w for u in us for w in re.findall("[a-z]{6,}", u)} for us in (urls.sample_urls(6000)[0], held)]
    assert len(words[0] & words[1]) < 0.02 * len(words[1])
    wrong = (m.score(held) >= 0.5) != y
    assert wrong.mean() < 0.06 and wrong[y == 0].mean() < 0.04
    assert not {f for f in urls.FEATURES if "word" in f}
    assert m.score([None, "", "nothing", "http://" + "a" * 100_000]).shape == (4,)


def _trees_by_hand(x, y, rate, penalty, edges):
    """One tree of depth 1: every feature and cut tried, with the sums taken anew."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = max(((g[x[:, j] < e].sum() ** 2 / (h[x[:, j] < e].sum() + penalty) + g[x[:, j] >= e].sum() ** 2 / (h[x[:, j] >= e].sum() + penalty), -j, -e) for j in range(x.shape[1]) for e in edges[j]))
    j, e = -best[1], -best[2]
    value = [-rate * g[s].sum() / (h[s].sum() + penalty) for s in (x[:, j] < e, x[:, j] >= e)]
    return 1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.where(x[:, j] < e, *value))))


def test_url_processes_that_were_left_out_are_not_false_alarms():
    for name in ("encyclopedias", "source trees", "shops", "news", "interfaces"):
        m = urls.Model(*urls.sample_urls(4000, without=(name,)), trees=40)
        held, y = urls.sample_urls(300, seed=11, pool=1, only=(name,))
        assert not y.any() and (m.score(held) >= 0.5).mean() < 0.2, name
    assert set(urls.sample_urls(50, only=("redirects",))[1]) == {1}


def test_well_known_shapes_of_urls_are_allowed():
    m = urls.Model(*urls.sample_urls())
    fine = [
        "https://en.wikipedia.org/wiki/Central_limit_theorem", "https://github.com/apache/spark/blob/master/core/src/main/scala/org/apache/spark/SparkContext.scala", "https://www.youtube.com/watch?v=dQw4w9WgXcQ",
        "https://www.amazon.com/dp/B08N5WRWNW", "https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster", "https://arxiv.org/abs/1706.03762", "https://docs.python.org/3/library/itertools.html#itertools.chain",
    ]
    assert (m.score(fine) < 0.2).all()
    assert (m.score(["http://xk3j9qpl2vz8.top/a8f3", "http://192.168.3.4:8081/login.php", "http://cheap-pills-online-best-4411.biz/"]) > 0.8).all()


def test_boosted_trees_split_as_a_plain_search_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).round(1)
    y = (x[:, 2] + rng.normal(0, 0.5, 400) > 0.3).astype(float)
    m = urls.Trees(trees=1, depth=1).fit(x, y)
    assert np.allclose(m.score(x), _trees_by_hand(x, y, m.rate, m.penalty, m.edges))


def test_secret_model_parts_samples():
    table, threshold = secrets.train(4000)
    t = np.array(table).reshape(128, 128)
    score = lambda s: t[[ord(c) for c in s[:-1]], [ord(c) for c in s[1:]]].mean()
    keys, plain = secrets.samples(4000)
    assert np.mean([score(s) > threshold for s in keys[2000:]]) > 0.9 and np.mean([score(s) > threshold for s in plain[2000:]]) < 0.01


def test_longest_common_subsequence():
    items = decontam.Items([(1, "one two three four five six"), (2, None), (3, "  ")][:1] + [(4, "Question? Answer: forty two")])
    assert items.common(0, decontam.words_of("zero one x two y six three")) == 3
    assert items.answers[1] == {b"forty", b"two"}
    assert zlib.crc32(b"") == 0
