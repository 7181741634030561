"""Each corpus operator against a plain Python version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sequent.llm import idplanes, jaccard, lm, mixing, neardup, packing, pii, quality, tokens, topk, urlfilter, words
from sequent.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null, empty, blank and long texts, repeated rows, null ids and sources, and columns that clash."""
    random.seed(7)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    long = text(5000) + "x" * 3000 + " " + text(50)
    base = text(120)
    rows = [(k, text(random.randint(1, 150)), "en", f"s{k % 4}", 5) for k in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", None, 3), (103, long, "de", "s1", len(long)), (104, "Été ÀB's don't <|endoftext|> 12.5% 漢字", "fr", "ß", 9)]
    rows += [(None, text(30), "en", "s2", 1), (None, None, "en", "s2", 1), (7, rows[7][1], "en", "s3", 5), (200, base, "en", "s0", 1), (201, base, "en", "s0", 1), (202, base + " more", "en", "s0", 1), (203, base.replace(" ", "  "), "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("part", "local", "h", "key", "number", "size", "token", "rows", "node")}), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_encoder_equals_the_whole_tokenizer(plain):
    random.seed(1)
    letters = "".join(map(chr, range(1, 0x180))) + "漢字́ﬁ\u2003\u00a0"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", "<|endoftext|> a<|startoftext|>b", "I'm we've 's ''s !'s", "a" * 5000, ("wörd " * 300_000) + "end"]
    got = tokens.encoder(tokens.word_vocabulary()).texts(texts)
    assert [g.tolist() for g in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip(plane):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1000, dtype=np.uint64).astype("<u4")
    assert (idplanes.ids_of(idplanes.planes_of(ids, plane), len(ids), plane) == ids).all()


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_id_planes(odd, none, plain, plane):
    docs, rows = odd
    got = idplanes.id_planes(docs, tokens.word_vocabulary(), block_ids=300, plane=plane).collect()
    want = collections.Counter((d, len(plain(t)) + 1, crc([*plain(t), 2])) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert idplanes.id_planes(none, tokens.word_vocabulary()).count() == 0


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= capacity
    return len(by)


def test_packing(odd, none, plain):
    docs, rows = odd
    got = packing.best_fit_packing(docs, tokens.word_vocabulary(), capacity=256).collect()
    used = check_packing(got, 256)
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = [*plain(t), 0]
        want.update((d, k, k * 256, len(ids[k * 256 : k * 256 + 256]), crc(ids[k * 256 : k * 256 + 256])) for k in range(-(-len(ids) // 256)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert used <= -(-sum(r.length for r in got) // 256) * 1.05 + 1
    assert packing.best_fit_packing(none, tokens.word_vocabulary()).count() == 0


def best_fit(lengths, capacity):
    """Sequences of sequential best-fit decreasing."""
    import bisect

    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        opened += k == len(gaps)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - n)
    return opened


@pytest.mark.parametrize("kind", ["mixed", "long", "thirds", "short"])
def test_packs_as_well_as_sequential_best_fit(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {"mixed": np.minimum(100, rng.integers(1, 140, 3000)), "long": rng.integers(40, 70, 1500), "thirds": np.full(900, 33), "short": rng.geometric(0.2, 3000)}[kind].tolist()
    rows = spark.createDataFrame([(k, 0, int(n), "clash") for k, n in enumerate(lengths)], "doc_id long, piece int, length int, number string").repartition(4)
    got = packing.pack(rows, 100).collect()
    assert sorted(r.length for r in got) == sorted(lengths) and {r.number for r in got} == {"clash"}
    assert check_packing(got, 100) <= best_fit(lengths, 100) * 1.02 + 2


def test_parentheses_pair_up():
    for seed in range(30):
        opens = np.random.default_rng(seed).random(200) < 0.5
        want, stack = [-1] * 200, []
        for k, o in enumerate(opens):
            if o:
                stack.append(k)
            elif stack:
                want[k] = stack.pop()
                want[want[k]] = k
        assert packing.paired(opens).tolist() == want


def test_mixing(odd, none):
    docs, rows = odd
    got = mixing.mix(docs, block=8, shard_blocks=16).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, left, target, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not full:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum((c["to"] - c["from"]) * c["times"] for c in r.cuts)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 * 8 for s in names)
    again = mixing.mix(docs.repartition(5), block=8, shard_blocks=16).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0
    cut = mixing.cut_texts(mixing.mix(docs, block=8, shard_blocks=16, carry=("text",)).select("doc_id", "text", "cuts")).collect()
    assert sum(len(split(r.text)) for r in cut) == sum(taken.values())


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(3)
    shares = {g: [rng.random() * 10 ** rng.randint(0, 3) for _ in range(8)] for g in range(6)}
    rows = [(g, p, s, math.ceil(s * 120 / sum(own)) + rng.choice([0, 0, 9]), 120) for g, own in shares.items() for p, s in enumerate(own)]
    got = mixing.apportioned(spark.createDataFrame(rows, "g int, p int, share double, most long, seats long"), ["g"], "p", "share", "most", "seats").collect()
    for g in range(6):
        own = [r for r in rows if r[0] == g]
        quotients = sorted(((-s / (2 * k - 1), p) for _, p, s, most, _ in own for k in range(1, most + 1)))[:120]
        want = collections.Counter(p for _, p in quotients)
        assert {r.p: r.quota for r in got if r.g == g} == {p: want[p] for _, p, *_ in own}


def jaccard_links(rows):
    sets = []
    for _, t, *_ in rows:
        w = split(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return [[j for j in range(len(rows)) if j != i and a and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-12] for i, a in enumerate(sets)]


def test_jaccard_classes(odd, none, spark):
    docs, rows = odd
    random.seed(5)
    base = ["w%d" % random.randint(0, 10**6) for _ in range(200)]
    for k in range(60):  # near copies of one text, at all similarities
        own = list(base)
        for _ in range(random.randint(0, 8)):
            own[random.randrange(200)] = "x%d" % random.randint(0, 10**6)
        rows = [*rows, (1000 + k, " ".join(own), "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows[-60:], DOCS), allowMissingColumns=True)
    got = jaccard.jaccard_classes(docs, limit=16, block=16).collect()
    links = jaccard_links(rows)
    assert collections.Counter((r.doc_id, r.n_links) for r in got) == collections.Counter((d, len(x)) for (d, *_), x in zip(rows, links, strict=True))
    seen, want = set(), collections.Counter()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            first = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            want.update((rows[j][0], first) for j in group)
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    assert jaccard.jaccard_classes(none).count() == 0


def test_jaccard_recall_of_planted_links(spark):
    rng = random.Random(17)
    words_ = [f"w{k}" for k in range(20_000)]
    rows, family = [], []
    for k in range(150):
        base = [rng.choice(words_) for _ in range(rng.choice([12, 40, 150, 400]))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = rng.choice(words_)
            family.append(k)
            rows.append((len(rows), " ".join(own)))
    links = [len(x) for k in range(150) for x in jaccard_links([r for r, f in zip(rows, family, strict=True) if f == k])]
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] <= n for k, n in enumerate(links)) and sum(links) > 500
    assert sum(got.values()) >= 0.995 * sum(links)


def test_jaccard_blocks_change_nothing(spark):
    rng = random.Random(19)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(140):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, jaccard.jaccard_classes(df, **sizes).collect())) for sizes in ({}, {"block": 20, "block_bytes": 9_000, "limit": 32}))
    assert one == many and [r[3] for r in one] == [len(x) for x in jaccard_links(rows)]


def plain_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for rank, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind != "ip" or all(int(x) <= 255 for x in m.group().split("."))) and (kind != "card" or 14 <= len(d) <= 19 and luhn) and (kind != "phone" or 10 <= len(d) <= 15):
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_pii_base(spark, odd, none):
    random.seed(3)
    letters = "ab.@-+0123456789 ()%_é\U0001f600\n"
    rows = [(k, "".join(random.choice(letters) for _ in range(random.randint(0, 60)))) for k in range(2500)]
    rows += [(3000, "4111 1111 1111 1111 and +1 (555) 123-4567, a@b.co.uk 1.2.3.4"), (3001, "1" * 9000 + " " + "a" * 30000 + " a@b.c@d.e.f " + "1 " * 5000), (3002, None), (3002, None)]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t in rows:
        spans, r = plain_spans(t), by[k]
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == n for s in spans) for n in range(4)]
    assert pii.digest(odd[0]).count() == len(odd[1]) and pii.digest(none).count() == 0


def test_pii_terms_that_reveal(spark):
    random.seed(2)
    filler = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    pick = lambda n: " ".join(random.choice(filler) for _ in range(n))
    rows = [(k, f"{pick(20)} ask Zorblatt at zed@corp.example today {pick(20)}") for k in range(8)]
    rows += [(100 + k, f"{pick(30)} today ask {pick(5)}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r.spans.split(",") for r in pii.digest(docs).collect()}
    for k, t in rows[:8]:
        at = t.index("Zorblatt")
        assert f"term:{at}:{at + 8}" in by[k]
        assert not any(t[int(a) : int(b)] in ("ask", "today") for kind, a, b in (s.split(":") for s in by[k]) if kind == "term")
    assert all(by[k] == [""] for k, _ in rows[8:])
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert all("Zorblatt" not in clean[k] and "[EMAIL]" in clean[k] for k in range(8)) and clean[100] == rows[8][1]


def test_pii_terms_of_rare_entities(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    pick = lambda k, n: " ".join(words[(k * 7 + j * 13) % 200] for j in range(n))
    rows = [(k, f"{pick(k, 9)} ask Zorblatt at u{k}@corp.example {pick(k + 3, 9)} once{chr(97 + k)}") for k in range(4)]
    rows += [(100 + k, f"{pick(k, 30)} ask n{k} {pick(k, 5)}") for k in range(300)]
    rows += [(500, rows[0][1])] * 20
    by = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows[:4]:  # each email stands in one text, its domain in four
        at, once = t.index("Zorblatt"), t.index("once")
        assert f"term:{at}:{at + 8}" in by[k].split(",")
        assert f"term:{once}:" not in by[k] and f"term:{t.index('ask')}:" not in by[k]
    assert by[500] == by[0] and all(by[k] == "" for k in range(100, 400))


def test_pii_terms_far_from_the_entity(spark):
    pick = lambda k, n: " ".join(f"w{chr(97 + (k + j) % 25)}{chr(97 + (k * 7 + j) % 26)}" for j in range(n))
    rows = [(k, f"ÉZorblatt\U0001f600 {pick(k, 40)} u{k}@corp.example {pick(k + 3, 40)} ézorblatt") for k in range(6)]
    rows += [(50, f"the ézorblatt {pick(9, 9)}")] + [(100 + k, pick(k, 60)) for k in range(300)]
    docs = spark.createDataFrame([*rows, (60, None)], "doc_id long, text string")
    by = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term")] for r in pii.digest(docs).collect()}
    for k, t in rows[:6]:
        assert by[k] == ["term:0:9", f"term:{len(t) - 9}:{len(t)}"]
    assert by[50] == ["term:4:13"] and all(by[k] == [] for k in [60, *range(100, 400)])
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert all("zorblatt" not in clean[k].lower() for k in [*range(6), 50]) and clean[100] == rows[7][1] and clean[60] is None


def plain_terms(texts, share=0.6, remove_at=0.9, bits=4.0, chance=0.01):
    """(start, end) -> replacement of the term spans of each text, straight from the definition."""
    different = sorted({t for t in texts if t is not None})
    words_of = {t: {m.group().lower() for m in regex.finditer(r"\p{L}{3,}", t)} for t in different}
    entities = {}
    for t in different:
        own = set()
        for a, rank, b, _ in plain_spans(t):
            text, number = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
            group = (text.split("@", 1)[-1], text.rpartition(".")[0], number[:6], number[:-7])[rank]
            own |= {(0, rank, number if rank >= 2 else text), (1, rank, group), (2, rank)}
        entities[t] = own
    found = {}
    often = [collections.Counter(x for t in different for x in own[t]) for own in (words_of, entities)]
    tests = math.prod(sum(n > 1 for n in c.values()) for c in often)
    for w in (w for w, n in often[0].items() if n > 1):
        having = [t for t in different if w in words_of[t]]
        for e in set().union(*(entities[t] for t in having)):
            usual = sum(e in entities[t] for t in different) / len(different)
            q = sum(e in entities[t] for t in having) / len(having)
            p = (q * len(having) + usual) / (len(having) + 1)
            apart = q * math.log2(q / usual) + ((1 - q) * math.log2((1 - q) / (1 - usual)) if q < 1 else 0)
            if p >= share and math.log2(p / usual) >= bits and q > usual and len(having) * apart >= math.log2(tests / chance):
                found[w] = "" if p >= remove_at else found.get(w, "[TERM]")
    return [{} if t is None else {m.span(): found[m.group().lower()] for m in regex.finditer(r"\p{L}{3,}", t) if m.group().lower() in found and not any(a < m.end() and m.start() < b for a, _, b, _ in plain_spans(t))} for t in texts]


def test_pii_terms_equal_plain_ones(spark):
    random.seed(12)
    filler = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    pick = lambda n: " ".join(random.choice(filler) for _ in range(n))
    rare = [f"name{chr(97 + k)}" for k in range(12)]
    whose = [0] * 12 + [1 + k // 4 for k in range(44)]
    texts = [f"{pick(12)} {rare[n]} {(f'u{k}@d{n}.org', f'10.{n}.7.{k}', f'+1 55{n} 1234 {1000 + k}')[n % 3]} {pick(9)}" for k, n in enumerate(whose)]
    texts += [f"{pick(15)} {random.choice(rare)} {pick(3)}" for _ in range(6)] + [pick(25) for _ in range(700)] + [None, "", "x" * 50_000, texts[0], texts[0]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    by = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    want = plain_terms(texts)
    assert sum(map(len, want)) > 20 and {v for x in want for v in x.values()} >= {"", "[TERM]"}
    for k in range(len(texts)):
        assert sorted(tuple(map(int, s.split(":")[1:])) for s in by[k].split(",") if s.startswith("term")) == sorted(want[k]), texts[k]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    for k, t in enumerate(texts[:62]):
        parts = sorted([(a, b, f"[{kind.upper()}]") for a, _, b, kind in plain_spans(t)] + [(*s, v) for s, v in want[k].items()])
        made, at = "", 0
        for a, b, v in parts:
            made, at = made + t[at:a] + v, b
        assert clean[k] == made + t[at:]


def test_pii_shuffled_entities_tell_nothing_and_planted_ones_do(spark):
    random.seed(31)
    filler = ["".join(random.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40_000)]
    pick = lambda n: " ".join(random.choice(filler) for _ in range(n))
    mails = [f"u{random.randrange(150)}@d{random.randrange(8)}.org" for _ in range(400)]
    texts = [f"{pick(25)} {mails[k] if k < 400 else ''} {pick(15)}" for k in range(2000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sum("term" in r.spans for r in pii.digest(docs).collect()) == 0
    assert sum("term" in r.spans for r in pii.digest(docs.select("doc_id", "text"), chance=1e30).collect()) > 20  # without the test there are many
    planted = [(5000 + k, f"{pick(20)} Quillfeather {pick(4)} quill@feather.example {pick(5)}") for k in range(4)]
    by = {r.doc_id: r.spans for r in pii.digest(docs.union(spark.createDataFrame(planted, docs.schema))).collect()}
    assert {k for k, x in by.items() if "term" in x} == {k for k, _ in planted}


def test_pii_of_a_very_long_text(spark):
    log = " ".join(f"login of u{k}@h{k % 7}.org from 10.{k % 250}.{k // 250}.7 telling" for k in range(20_000))
    docs = spark.createDataFrame([(1, log), (2, log + " end"), (3, "telling")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert time.time() - start < 60 and (got[1].n_email, got[1].n_ip) == (20_000, 20_000)
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in plain_spans(log)).encode()).hexdigest()


def test_running_totals(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000)], "v array<int>")
    got = rows.select("v", pii.running(F.col("v"), 0, lambda a, x: a + x).alias("sums"), pii.running(F.reverse("v"), 10**6, F.least).alias("least")).collect()
    for r in got:
        assert r.sums == [sum(r.v[:k]) for k in range(len(r.v))] and r.least == [min([10**6, *r.v[::-1][:k]]) for k in range(len(r.v))]


def test_pii_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "pii_base", "pii_terms", "__h", "__g", "h", "g", "row", "__row"]
    docs = spark.createDataFrame([(1, "mail a@b.org", *"abcdefgh"), (2, None, *"abcdefgh")], names)
    got = pii.sanitised(docs)
    assert got.columns == names
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "mail [EMAIL]", *"abcdefgh"), (2, None, *"abcdefgh")]
    assert pii.sanitised(docs.withColumnRenamed("text", "body"), "body").orderBy("doc_id").first().body == "mail [EMAIL]"
    assert [len(r.pii_base) for r in pii.with_spans(docs).orderBy("doc_id").collect()] == [1, 0] and pii.digest(docs).count() == 2


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return ("", "", None, "allow")
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path, best = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])], None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0, 0, "", ""), (len(h), len(rule), verdict, rule))
    return (host, path, best[3] if best else None, best[2] if best else "allow")


def test_url_rules(spark):
    random.seed(2)
    part = lambda: random.choice(["a", "b", "net", "ORG", "example", "fr", ""])
    urls = [(k, random.choice(["http://", "https://", "", "x://"]) + ".".join(part() for _ in range(random.randint(0, 4))) + random.choice(["", "/", "/en", "/en/x", "/fr/", "/a/b/c", "?q=/", "#/en/", "/en?x"])) for k in range(1500)]
    urls += [(None, None), (9001, ""), (9002, "http://"), (9003, "a\n://x.net/en/\nq"), (5, "http://a.net/en/x"), (5, "http://a.net/en/x")]
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("allow", "org/fr/"), ("block", "a.net/en"), ("allow", "b.a.net/"), ("block", "net/en/x"), ("allow", "example"), ("block", "fr.org/a/"), ("allow", "org/a/b/"), ("block", "")]
    pages = spark.createDataFrame([(*u, "x", "y") for u in urls], "page_id long, url string, host string, key string")
    frame = spark.createDataFrame([*rules, (None, None)], "verdict string, rule string")
    got = urlfilter.judge(pages, frame).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((k, *plain_verdict(u, rules)) for k, u in urls)
    assert urlfilter.judge(pages.limit(0), frame).count() == 0
    assert all(r.verdict == "allow" for r in urlfilter.judge(pages, frame.limit(0)).collect())


def test_quality_on_held_out_labels(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality.score(docs.withColumn("label", F.lit(9)), labels.where(half)).join(labels.where(~half), "doc_id").collect()
    right = np.mean([r.accepted == (r.quality == 1) for r in got])
    kept = np.mean([r.accepted for r in got if r.quality == 1])
    assert right >= 0.95 and kept >= 0.98
    assert quality.score(none, labels).count() == 0


def test_quality_rounds_equal_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(30))  # repeated rows
    got = quality.fitted(docs, labels, 1000, 3, 0.9, 7, 0.01, 0)
    label = {r.doc_id: r.quality for r in labels.collect()}
    keyed = docs.withColumn("key", F.xxhash64("text", "source", "lang", F.col("n_chars").cast("long"))).collect()
    rows = {r.key: r for r in keyed if split(r.text)}
    views = {k: [quality.content([r.text])[0].astype("f4"), quality.metadata([r.source], [r.lang], [r.n_chars])[0].astype("f4")] for k, r in rows.items()}
    have = [r for r in keyed if split(r.text)]
    mine = sorted((min(r.key for r in have if r.doc_id == d), q) for d, q in label.items() if any(r.doc_id == d for r in have))
    mine, y = [k for k, _ in mine], np.array([float(q) for _, q in mine])
    held = np.zeros(len(y), bool)
    for value in (0, 1):
        held[np.flatnonzero(y == value)[1::4]] = True
    stack = lambda keys, v: np.array([views[k][v] for k in keys], np.float32).reshape(len(keys), (72, quality.SOURCES + quality.LANGS + quality.LENGTHS)[v])
    want = quality.CoTrained([stack(mine, v) for v in (0, 1)], y, held)
    pool = {r.key for r in have if r.doc_id not in label}
    total = len(pool)
    for _ in range(3):
        picks = {}
        for v in (0, 1):
            for lab in (0, 1):
                doubt = [((1 - p) if lab else p, k) for k in pool for p in [round(float(want.calibrated(v, stack([k], v))[0]), 9)]]
                picks[v, lab] = {k for d, k in sorted(doubt)[:7] if d <= 1 - 0.9}
        torn = (picks[0, 0] | picks[1, 0]) & (picks[0, 1] | picks[1, 1])
        for (v, lab), keys in picks.items():
            want.learn(1 - v, stack(sorted(keys - torn), 1 - v), lab)
        pool -= set().union(*picks.values())
        want.fit()
    want.finish(0.01)
    assert len(pool) < total
    for v in (0, 1):
        assert np.allclose(got.views[v].w, want.views[v].w, atol=1e-6)
    assert np.allclose(got.joint.w, want.joint.w, atol=1e-6) and math.isclose(got.accept, want.accept, abs_tol=1e-9)


def test_quality_edge_rows(odd, spark):
    docs, rows = odd
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (1, None), (3, 7), (3, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(not r.accepted and r.quality_score == 0 for r in got if r.text is None or not r.text.strip())
    alone = quality.score(docs, labels.where("quality = 1")).collect()
    assert all(r.accepted for r in alone if r.text and r.text.strip())


def vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((5, 16))
    rows = [(k, (centre[k % 5] + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(1000 + k, rng.standard_normal(16).astype(np.float32).tolist()) for k in range(100)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (3, rows[3][1]), (3000, rows[3][1]), (3001, [1e30 * x for x in rows[4][1]])]
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, node string"), rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(np.float32(x)) for x in v) and any(v)


def test_embedding_near_duplicates(spark):
    df, rows = vectors(spark)
    got = neardup.near_duplicates(df, load=8, block=16).collect()
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v) else None for _, v in rows]
    links = [[j for j, b in enumerate(unit) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9] for i, a in enumerate(unit)]
    total = sum(map(len, links))
    assert sum(r.n_links for r in got) >= 0.95 * total and total > 500
    most = collections.Counter()
    for (k, _), x in zip(rows, links, strict=True):
        most[k] = max(most[k], len(x))
    assert all(r.n_links <= most[r.vec_id] for r in got) and len(got) == len(rows)
    assert all(r.kept and r.n_links == 0 for r in got if 2000 <= r.vec_id <= 2005)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("load", [8_192, 64])
def test_embedding_recall_of_planted_links(spark, load):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((2000, 64))
    rows = [v / np.linalg.norm(v) for v in base]
    for k in range(600):  # partners at cosines from 0.85 to 0.95, a third of them to one vector
        a = rows[0 if k % 3 == 0 else k]
        across = rng.standard_normal(64)
        across -= across @ a * a
        c = rng.uniform(0.85, 0.95)
        rows.append(c * a + math.sqrt(1 - c * c) * across / np.linalg.norm(across))
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.9).sum(1)
    df = spark.createDataFrame([(k, np.float32(v).tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, load=load, block=512 if load > 64 else 48).collect()}
    found = sum(got.values())
    assert all(got[k] <= want[k] for k in got) and want.sum() > 400
    assert found >= 0.97 * want.sum()


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(6)
    codes = rng.integers(-(1 << 62), 1 << 62, 400)
    codes[50:120] = codes[50]
    codes[120:160] ^= 1 << rng.integers(0, 60, 40)
    rows = [(k, int(c)) for k, c in enumerate(codes)] + [(7, int(codes[7])), (7, int(codes[8])), (None, 5), (900, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, code long, block string")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("id % 20 = 0 or id = 55"), k=6, block=64, slab=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbor_id))
    whole = sorted({r for r in rows if None not in r})
    for q in [k for k in range(400) if k % 20 == 0] + [55]:
        near = sorted((bin((c ^ int(codes[q])) & (2**64 - 1)).count("1"), k) for k, c in whole if k != q)
        assert got[q] == near[:6]
    assert topk.top_k(df.limit(0), df).count() == 0


def test_lm_scores(odd, none, spark):
    docs, rows = odd
    got = lm.scores(docs, batch_chars=2000, range_keys=500).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    texts = [(d, [*split((t or "").translate(low)), "<END>"]) for d, t, *_ in rows]
    count = collections.Counter(w for d, ws in texts if fold(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((d, fold(d) == 0, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in texts)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.scores(none).count() == 0


def plain_lm(texts, fold):
    """score of each text straight from the definition: interpolated bigrams, weights by EM on the deleted fold."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    lines = [(fold(d), ["<BEGIN>", *split((t or "").translate(low)), "<END>"]) for d, t in texts]
    bucket = lambda n: n.bit_length()

    def counted(folds):
        single, pair = collections.Counter(), collections.Counter()
        for f, ws in lines:
            if f in folds:
                single.update(ws)
                pair.update(zip(ws, ws[1:], strict=False))
        begun = single.pop("<BEGIN>", 0)
        return single, pair, {**single, "<BEGIN>": begun}, sum(single.values())

    single, pair, context, n = counted(range(2, 10))
    step = lambda p: None if p == 0 else round(8 * math.log2(p))
    value = lambda s: 0.0 if s is None else 2.0 ** (s / 8)
    seen = collections.defaultdict(collections.Counter)
    for f, ws in lines:
        if f == 1:
            for h, w in zip(ws, ws[1:], strict=False):
                c = context.get(h, 0)
                seen[bucket(c)][step(pair[h, w] / max(c, 1)), step(single[w] / max(n, 1))] += 1
    found = {}
    for b, cells in seen.items():
        own, w = [(value(p), value(s), 1 / (len(single) + 1), k) for (p, s), k in cells.items()], [1 / 3] * 3
        for _ in range(100):
            share = [0.0] * 3
            for *p, k in own:
                total = sum(x * y for x, y in zip(p, w, strict=True))
                for i in range(3):
                    share[i] += k * p[i] * w[i] / total
            after = [x / sum(k for *_, k in own) for x in share]
            if max(abs(x - y) for x, y in zip(after, w, strict=True)) < 1e-9:
                break
            w = after
        w[2] = max(w[2], 1e-7)
        found[b] = [x / sum(w) for x in w]

    def weights(b):
        near = [x for x in found if (x == 0) == (b == 0)]
        return found[min(near, key=lambda x: (abs(x - b), x))] if near else ([0, 0.5, 0.5] if b == 0 else [1 / 3] * 3)

    single, pair, context, n = counted(range(1, 10))
    out = []
    for _, ws in lines:
        total = 0.0
        for h, w in zip(ws, ws[1:], strict=False):
            c = context.get(h, 0)
            x = weights(bucket(c)) if n else [0, 0, 1]
            total += math.log10(x[0] * pair[h, w] / max(c, 1) + x[1] * single[w] / max(n, 1) + x[2] / (len(single) + 1))
        out.append(total)
    return out


def test_lm_scores_equal_plain_ones(odd, spark):
    random.seed(21)
    follow = {w: [f"{w}{k}" for k in range(4)] for w in "abcdefgh"}
    texts = [(d, t) for d, t, *_ in odd[1]]
    for k in range(150):
        own = []
        for _ in range(random.randint(0, 30)):
            w = random.choice("abcdefgh")
            own += [w, random.choice(follow[w]).upper() if k % 7 == 0 else random.choice(follow[w])]
        texts.append((5000 + k, " ".join(own)))
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    want = sorted((str(d), round(x, 5)) for (d, _), x in zip(texts, plain_lm(texts, fold), strict=True))
    for sizes in ({"batch_chars": 3000, "range_keys": 400}, {"batch_chars": 500, "range_keys": 90, "fan": 3}, {}):
        got = lm.scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), **sizes).collect()
        made = sorted((str(r.doc_id), round(r.score, 5)) for r in got)
        assert [d for d, _ in made] == [d for d, _ in want] and all(abs(x - y) < 2e-5 for (_, x), (_, y) in zip(made, want, strict=True))


def test_lm_totals_have_64_bits():
    keys = np.array([5, 9, 2**63 + 1], np.uint64)
    rows = [r for asker, n in ((1, 3_000_000_000), (2, 3_000_000_000), (3, 1 << 40)) for b in lm.request_rows(1, asker, keys, [np.array([n, 0, 1]), np.array([1, 0, n])], 1) for r in b.to_pylist()]
    got = lm.add_up(pa.Table.from_pylist(rows))
    assert got["asker"].to_pylist() == [1, 2, 3] and got["new_kept"].to_pylist() == [2, 0, 0] and got["new_train"].to_pylist() == [2, 0, 0]
    for r in got.to_pylist():
        assert lm.expanded(r["kept"], lm.COUNT).tolist() == [6_000_000_000 + (1 << 40), 0, 3]
        assert lm.expanded(r["deleted"], lm.COUNT).tolist() == [3, 0, 6_000_000_000 + (1 << 40)]


def test_lm_askers_make_rows_for_as_many_ranges_as_the_fan_has(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(200))) for k in range(40)], "doc_id long, text string")
    batches = lm.batched(docs.withColumn("role", F.lit(lm.KEPT)), 1500).cache()
    number = batches.count()
    made = []
    keep = lm.stored
    lm.stored = lambda df, name: made.append((name, out := keep(df, name))) or out
    try:
        answers = lm.answers_to(batches, (60, 60), number, 4).cache()
        answers.count()
    finally:
        lm.stored = keep
    assert [name for name, _ in made] == ["lm-requests", "lm-teams", "lm-teams"]
    for _, requests in made:
        assert requests.groupBy("kind", "asker").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] <= 4 * 4 * 4
    assert made[0][1].groupBy("kind", "asker").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 4
    assert answers.agg(F.sum("new_kept")).first()[0] == 40 * 200 + 2 + 40 * 201  # words, the end, the place before; pairs
    assert answers.groupBy("asker", "kind").count().count() == 2 * number


def test_lm_distribution_sums_to_one():
    found = lm.weights_by_em([(3, -8, -40, 10), (3, lm._NONE, -40, 30), (3, lm._NONE, lm._NONE, 5)], 1e-3)
    assert math.isclose(sum(found[3]), 1.0) and all(w > 0 for w in found[3])


def test_lm_beats_its_base_on_text_with_order(spark):
    random.seed(9)
    follow = {w: [f"{w}{k}" for k in range(3)] for w in "abcdefgh"}
    docs = []
    for k in range(300):
        own = []
        for _ in range(60):
            w = random.choice("abcdefgh")
            own += [w, random.choice(follow[w])]
        docs.append((k, " ".join(own)))
    got = [r for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}}


def test_long_texts_are_cut_at_white_space_only():
    text = ("ab " * 700_000) + "z" * (3 << 20) + " end"
    hashes, counts = words.word_hashes([text, None, "end"])
    assert counts.tolist() == [700_002, 0, 1] and hashes[-1] == hashes[-2]


def alternating(letters, n=2048):
    """The Thue-Morse word: with its complement it collides under any polynomial hash modulo 2^64."""
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse(spark, plain):
    a, b = alternating("ab"), alternating("ba")
    hashes, _ = words.word_hashes([a, b, f"{a} {b}", "é" * 40 + "x", "é" * 40 + "y"])
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[2] and hashes[1] == hashes[3]
    assert [x.tolist() for x in tokens.encoder(tokens.word_vocabulary()).texts([a, b])] == [plain(a), plain(b)]
    docs = spark.createDataFrame([(1, a), (2, b), (11, f"{b} {a}"), (12, a)], "doc_id long, text string")
    by = {r.doc_id: r for r in idplanes.id_planes(docs, tokens.word_vocabulary()).collect()}
    assert {k: by[k].ids_crc32 for k in by} == {k: crc([*plain(t), 2]) for k, t in [(1, a), (2, b), (11, f"{b} {a}"), (12, a)]}
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_classes(docs).collect()} == {1: 1, 2: 0, 11: 0, 12: 1}
    learnt = [d for d in (1, 2, 11, 12) if zlib.crc32(str(d).encode()) % 10]
    known = collections.Counter(w for d, t in [(1, a), (2, b), (11, f"{b} {a}"), (12, a)] if d in learnt for w in [*t.split(), ""])
    assert {r.doc_id: r.n_known for r in lm.scores(docs).collect()} == {1: (known[a] > 0) + 1, 2: (known[b] > 0) + 1, 11: (known[a] > 0) + (known[b] > 0) + 1, 12: (known[a] > 0) + 1}
