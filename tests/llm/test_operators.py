"""The corpus operators against plain versions, on small and awkward inputs."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import _common, ann, bpe, langid, media, mph, near, packing, pii, shards, simhash, toxicity, urls
from sluice.llm.components import connected_components

ODD = [None, "", " ", "a", "The cat's  hat\n\n is 42, ñandú! ", "日本語 テスト", "\x1c\x85\xa0 x", "İstanbul Å", "ab" * 3000, "1." * 2000, "+" * 500, "\x0b\x01 \x01"]
TEXTS = [*ODD, *ODD[3:6], " ".join(f"word{i % 97} is here" for i in range(4000)), "Hello <|endoftext|> there <|ENDOFTEXT|><|startoftext|>x"]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward and repeated texts, with columns whose names operators use themselves."""
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        h = mph.MinimalPerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        assert [h.slot(int(k)) for k in keys[:50]] == h.slots(keys[:50]).tolist()
    with pytest.raises(ValueError):
        mph.MinimalPerfectHash.build(np.array([3, 3], np.uint64))


def test_bpe(docs, none):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe.encode(docs, path, P.PATTERN))
    for i, t in enumerate(TEXTS):
        assert found[i].ids == library.encode_ordinary(t or "")
    back = by_id(bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN))
    assert all(bytes(back[i].raw) == (t or "").encode() for i, t in enumerate(TEXTS))
    trip = by_id(bpe.round_trip(docs, path, P.PATTERN))
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        assert (trip[i].n_tokens, trip[i].ids_sha256, trip[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0


def _plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def _classes(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in prints}


def test_simhash(docs, none):
    found = by_id(simhash.near_duplicates(docs))
    prints = {i: _plain_print(t) for i, t in enumerate(TEXTS)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in found.items()} == prints
    assert {i: r.component for i, r in found.items()} == _classes(prints)
    assert simhash.near_duplicates(none).count() == 0
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == set(_classes(prints).values())


def test_links_in_slices(spark, monkeypatch):
    """Groups beyond a slice give the same classes."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(6)]
    codes = {b ^ sum(1 << rnd.randrange(16, 64) for _ in range(rnd.randrange(4))) for b in base for _ in range(60)} | {rnd.getrandbits(64) for _ in range(60)}
    prints = dict(enumerate(sorted(codes)))
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in prints.items()]
    monkeypatch.setattr(simhash, "SLICE", 16)
    monkeypatch.setattr(simhash, "CHUNK", 24)
    monkeypatch.setattr(simhash, "TOGETHER", 7)
    edges = simhash.linked(spark.createDataFrame(signed, "i long, fp long"), "fp")
    of = {c: i for i, c in signed}
    named = spark.createDataFrame([(of[r.u], of[r.v]) for r in edges.collect()], "u long, v long")
    got = {r.node: r.component for r in connected_components(named, "u", "v").collect()}
    assert {i: got.get(i, i) for i in prints} == _classes(prints)


def test_gray_index():
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 4096, 800, dtype=np.uint64)]))
    index = simhash.GrayIndex(codes)
    asked, near = index.search(codes[::37], 3)
    for k, c in enumerate(codes[::37]):
        assert sorted(near[asked == k].tolist()) == np.flatnonzero(np.bitwise_count(codes ^ c) <= 3).tolist()
    for n in (1, 2, 15, 16, 17, 257):
        asked, near = simhash.GrayIndex(codes[:n]).search(codes[:n], 64)
        assert len({*zip(asked.tolist(), near.tolist())}) == n * n


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = rows.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    got = _common.spread_join(rows, one, ["k"], "n", 30_000)
    assert got.columns == ["k", "v", "m"]
    assert got.count() == 30_000 and got.where("m <> if(k = 7 AND v <> 7, 0, if(k = 7, 0, k))").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges, "u", "v").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_media(docs, none):
    store = media.MediaStore(docs)
    found = {r.key: r for r in store.described().collect()}
    raw = {r.key: bytes(r.media) for r in store.media().collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert media.unwrap(raw[i]) == p and r.media_sha256 == hashlib.sha256(raw[i]).hexdigest()
    assert media.MediaStore(none).described().count() == 0


def test_cuts_follow_content():
    data = random.Random(1).randbytes(200_000)
    ends = media.cuts(data)
    assert ends[-1] == len(data) and all(media.SHORTEST <= b - a <= media.LONGEST for a, b in zip([0, *ends], ends[:-1]))
    moved = {len(data) - e for e in ends}
    assert len(moved & {len(data) + 7 - e for e in media.cuts(b"1234567" + data)}) > len(ends) * 0.8


def test_pii(docs, spark, none):
    extra = ["mail a@b.co, x@y, a@b.c_d@e.ff", "1.2.3.4 and 999.1.1.1 and 0001.02.3.255.7", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-2030 +1 2", 'token = "24be64439e3e49cf46b2" b']
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    found = by_id(pii.detect(more))
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    for i, t in [*enumerate(TEXTS), *enumerate(extra, 100)]:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds for m in re.finditer(p, t or "") if good(k, m[0])]
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert found[i].spans.startswith(",".join(spans))
    assert pii.detect(none).count() == 0
    clean = by_id(pii.redact(more))
    assert clean[100].text.startswith("mail <EMAIL>, x@y, <EMAIL>")
    assert clean[4].text == TEXTS[4]


def test_em_ranks_labelers():
    """Form and words agree; the third labeler votes at random and is told from them."""
    yes, no = pii.YES, pii.NO
    patterns = {yes + 3 * yes + 9 * yes: 25, yes + 3 * yes + 9 * no: 25, yes + 9 * yes: 5, no: 60, no + 9 * yes: 60, no + 9 * no: 60}
    rates, post = pii.estimate(patterns)
    assert post[yes + 3 * yes + 9 * no] > 0.9 and post[no + 9 * yes] < 0.1
    apart = [abs(true[yes] - false[yes]) for true, false in rates]
    assert apart[0] > 0.8 and apart[2] < 0.35
    assert pii.estimate({}) == ([pii.START] * 3, {})


def test_added_spans(spark):
    """Secrets are told from long words and numbers by what was learned, also where no keyword stands before them."""
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = [f'some words token = "{key(40)}" more' for _ in range(30)] + [f"see internationalisationword{chr(97 + i % 26)} here" for i in range(60)]
    rows += [f"number {rnd.randrange(10**16, 10**17)} of them" for _ in range(20)]
    bare, names = f"just {key(40)}, alone", "Dear Mr. John Smith, name: Dr. Ann Lee"
    rows += [bare, names, "x" * 50_000, ""]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(rows)], "doc_id long, text string, secret string, row string")
    found = {i: r.spans for i, r in by_id(pii.detect(df)).items()}
    for i in range(30):
        at = rows[i].index('"') + 1
        assert found[i] == f"secret:{at}:{at + 40}"
    assert not any("secret" in found[i] for i in range(30, 110)) and found[len(rows) - 4] == "secret:5:45"
    assert found[len(rows) - 2] == found[len(rows) - 1] == ""
    clean = pii.redact(df)
    assert clean.columns == df.columns and by_id(clean)[0].secret == "a" and by_id(clean)[0].text == 'some words token = "<SECRET>" more'
    rates = pii.fit(pii.searched(df, "text", ["doc_id"], False)).rates
    assert rates.keys() == {"secret", "person"} and rates["secret"][0][0][pii.YES] > 0.8 > 0.2 > rates["secret"][0][1][pii.YES]


def test_local_phones_without_hyphens(spark):
    """Blanks and dots part the digits of a number as hyphens do: a text is searched whichever it has."""
    numbers = ["555 123 4567", "555.123.4567", "(555) 123 4567", "(555) 123.4567", "555-123-4567"]
    rows = [f"word {i}, phone: {n}" for n in numbers for i in range(10)] + [f"some {i} words" for i in range(10)]
    found = by_id(pii.detect(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    for i, t in enumerate(rows):
        assert found[i].spans == (f"local_phone:{t.index('phone') + 7}:{len(t)}" if i < 50 else ""), t


@pytest.mark.parametrize("kind", pii.KINDS)
def test_every_match_has_the_character_needed(spark, kind):
    """What a text must have to be searched for a kind leaves no match out."""
    pattern, needs = next(((w.pattern, w.needs) for w in pii.WIDER if w.kind == kind), (pii.BASE.get(kind), pii.NEEDS.get(kind)))
    texts = ["a@b.co", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 555 010 2030", "+15550102030", "555 123 4567", "(555) 123.4567", "abcdefgh12345678", "1980-02-03", "Mr John", "Dr. Ann Lee", "12 High Street", "bob at mail dot com", "bob [at] mail [dot] com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pii.matches(F.col("t"), pattern, needs)["found"].alias("some"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("all"))
    got = df.collect()
    assert any(r["all"] for r in got) and all(r.some == r["all"] for r in got)


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/5?x"), (2, "http://www.example.com/en/"), (3, "https://b.net/es/1"), (4, None), (5, "nothing"), (6, "http://x.org"), (7, "http://q.net/en/9#f"), (8, "http://notexample.com/en/2"), (9, "http://b.net/es")]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("a.example.com", "/en/5", "example.com/en/", "block")
    assert (found[2].rule, found[2].verdict) == ("www.example.com/en/", "allow")
    assert (found[3].rule, found[8].rule, found[9].rule) == ("net/es/", "com/", None)
    assert (found[4].host, found[4].path, found[5].host, found[6].path) == ("", "", "", "")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


def _plain_templates(rows, rules):
    """template and purity of each url, by a plain tree for each host."""

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        kind = lambda s: re.sub(r"^(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?=$|\.)", "{h}", re.sub(r"^[0-9]+(?=$|\.)", "{n}", s))
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), path, [kind(s) for s in path.removeprefix("/").split("/")]

    def rule(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    urls_ = [(i, *parts(u)) for i, u in rows]
    urls_ = [(i, h, p, s, rule(h, p)) for i, h, p, s in urls_]
    found = {}

    def differs(part, of, share):
        return of > 0 and abs(part - share * of) > urls.DIFFERENCE * (share * (1 - share) * of) ** 0.5

    def count(some):
        kinds = lambda level: [sum(len(s) == level for *_, s, _ in some), sum(len(s) > level and s[level].startswith("{") for *_, s, _ in some)]
        return len(some), sum(r is not None for *_, r in some), sum(r is not None and r.block for *_, r in some), kinds

    def grow(some, level, name, up):
        n, labelled, blocked, _ = count(some)
        children = {}
        for u in some:
            if len(u[3]) <= level:
                found[u[0]] = (name, (blocked + urls.PRIOR_WEIGHT * up) / (labelled + urls.PRIOR_WEIGHT))
            else:
                children.setdefault(u[3][level], []).append(u)
        inner = [u for c in children.values() for u in c]
        if not inner:
            return
        of_n, of_l, of_b, of_kinds = count(inner)
        of_kinds, ways = of_kinds(level + 1), {}
        for seg, own in children.items():
            k_n, k_l, k_b, k = count(own)
            kinds = [*zip(k(level + 1), of_kinds), (k_n - sum(k(level + 1)), of_n - sum(of_kinds))]
            alike = len(children) > 1 and not any(differs(x, k_n, y / of_n) for x, y in kinds) and not differs(k_b, k_l, of_b / max(1, of_l))
            variable = len(children) > urls.MOST_CHILDREN and of_n < urls.FEW * len(children)
            ways.setdefault("*" if variable or alike else seg, []).extend(own)
        for step, own in ways.items():
            _, l, b, _ = count(own)
            grow(own, level + 1, f"{name}/{step}", (blocked - b + urls.PRIOR_WEIGHT * up) / (labelled - l + urls.PRIOR_WEIGHT))

    for host in {u[1] for u in urls_}:
        grow([u for u in urls_ if u[1] == host], 0, "", urls.PRIOR)
    return {u[0]: (u[1], u[2], u[4].name if u[4] else None, *found[u[0]]) for u in urls_}


def _same_as_plain_templates(got, rows):
    want = _plain_templates(rows, urls.RULES)
    blocking = {r.name for r in urls.RULES if r.block}
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, template, purity = want[r.page_id]
        assert (r.host, r.path, r.rule, r.template) == (host, path, rule, template) and abs(r.purity - purity) < 1e-9
        assert r.verdict == ("block" if rule in blocking or rule is None and purity >= urls.REJECT_FROM else "allow")
    return {(r.rule is None, r.verdict) for r in got}


def test_templates_against_plain_tree(spark):
    """Merged branches, wildcards, deep paths, repeated and null rows, clashing columns."""
    rnd, rows = random.Random(12), []

    def add(url, times=1):
        rows.extend([(len(rows) + k, url) for k in range(times)])

    for k in range(40):  # labelled branches and one without labels that looks like them
        add(f"http://bad.net/{rnd.choice(['es', 'fr', 'pt'])}/{k}")
        add(f"http://shop.net/{rnd.choice(['es', 'fr'])}/{k}/x{k % 3}")
        add(f"http://shop.net/about/{rnd.choice('ab')}")  # another shape: stays apart, but the rest of the host counts
        add(f"http://free.org/{rnd.choice(['es', 'fr'])}/{k}")
        add(f"http://many.net/u{k}/es")
        add(f"http://mixed.example.com/{rnd.choice(['en', 'de'])}/{k}.html?q")
    add("http://bad.net/es/1", 50)
    add("http://deep.net/" + "/".join(["es", *"abcdefghijkl"]))
    add("http://deep.net/es" + "/x" * 300)
    for odd in (None, "", "no", "://", "http://", "http://h.net", "http://h.net/", "http://h.net//es//", "HTTP://H.NET/es/0123456789abcdef.html#x"):
        add(odd, 2)
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in rows], "page_id long, url string, host string, n double").repartition(5)
    kinds = _same_as_plain_templates(urls.judge(df, urls.RULES).collect(), rows)
    assert kinds == {(True, "block"), (True, "allow"), (False, "block"), (False, "allow")}


def test_registered_url_query_against_plain_tree(spark):
    from sluice.llm import registry

    for sf in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").collect()]
        _same_as_plain_templates(registry.queries()["op5_path_templates"](spark, f"/root/testdata/{sf}").collect(), rows)


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[200:500] = x[200]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, 5, "vec_id % 50 = 0", block=300).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 900, 50):
        s = np.round((y @ y[q]) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[q]), 12)
        s[q] = -2
        want = np.lexsort((np.arange(900), -s))[:5].tolist()
        assert len(got[q]) == 5
        hits += len({v for v, _ in got[q].values()} & set(want))
    assert hits / 90 >= 0.9 and set(got) == set(range(0, 900, 50))
    assert [v for v, _ in (got[250][k] for k in range(1, 6))] == [200, 201, 202, 203, 204]
    assert ann.nearest(df.limit(0), 5, "true").count() == 0


def test_toxicity(spark, none):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        text = [rnd.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            text[rnd.randrange(60)] = rnd.choice(["Zorkface!", "zorkhead", "quibnit"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    scores = by_id(toxicity.score(docs, model))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scores[i].score >= 0.7) == (i % 4 == 0) for i in held) / len(held) > 0.95
    spans = by_id(toxicity.tag(docs, model))
    found = {rows[i][1][s.start : s.end].lower().strip("!") for i in held if i % 4 == 0 for s in spans[i].spans}
    assert found and all(w in ("zorkface", "zorkhead", "quibnit") for f in found for w in f.replace("!", "").split())
    judged = by_id(toxicity.judged(docs, model))
    assert all(judged[i].score == scores[i].score and judged[i].spans == spans[i].spans for i in scores)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i in scores if scores[i].score < 0.7}
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


def test_toxicity_of_awkward_texts(spark, docs, none):
    """Null, empty and very long texts, clashing columns, and samples that lack a label."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(len(TEXTS))], "doc_id long, toxic int")
    model = toxicity.train([(1, f"bad zorkface{chr(97 + i)} thing {i}") for i in range(30)] + [(0, f"a fine thing {i}") for i in range(90)])
    long = spark.createDataFrame([(99, "fine " * 200_000 + "bad zorkfacex thing", "k", 1)], docs.schema)
    found = by_id(toxicity.judged(docs.union(long), model))
    assert len(found) == len(TEXTS) + 1 and found[0].score == found[1].score == found[2].score < 0.5
    assert found[99].spans and all(1_000_000 <= s.start < s.end <= 1_000_013 for s in found[99].spans)
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.withColumn("toxic", F.lit(1)))).collect()} == {1.0}


def test_observations_know_neighbours():
    tagger = toxicity._Tagger(toxicity.Model({"zork*": 5, "bad": 2}, None, np.zeros(3), 0.5))
    codes = [toxicity.parts_of(int(c)) for c in tagger.observe("a fine BAD! zorkhead day of all".split())]
    assert codes == [(0, 0, 0, 0), (0, 0, 1, 0), (2, 0, 2, 1), (5, 1, 1, 0), (0, 0, 2, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_training_works_in_bounded_memory(monkeypatch):
    """All segments count, whatever part of them is in work at a time; the driver holds a few arrays of that part."""
    rnd = np.random.default_rng(5)
    observed = [rnd.integers(0, toxicity.CODES, 128 * 40 + k, np.uint8) for k in range(300)]
    states = [rnd.integers(0, 2, len(o)).astype(np.uint8) for o in observed]
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    tracemalloc.start()
    chain = toxicity.fit_chain(observed, states)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # 12,300 segments; one array of theirs is 12.6 MB
    monkeypatch.setattr(toxicity, "SEGMENTS_AT_ONCE", 1 << 20)
    whole = toxicity.fit_chain(observed, states)
    assert np.allclose(chain.emit, whole.emit) and np.allclose(chain.step, whole.step)


def test_training_expects_what_all_paths_give():
    kinds = [((b"\x03\x00\x05\x07", b"\1\0\0\1"), 2), ((b"\x05\x05\x00", b"\1\1\0"), 1), ((b"\x07", b"\0"), 4)]
    emit, m = np.exp(np.linspace(-1, 1, toxicity.CODES)), np.array([[1.5, 0.5], [0.7, 2.0]])
    want, steps = np.zeros(toxicity.CODES), np.zeros((2, 2))
    for (o, _), n in kinds:
        paths = {}
        for path in itertools.product((0, 1), repeat=len(o)):
            paths[path] = np.prod([emit[c] for c, y in zip(o, path, strict=True) if y]) * np.prod([m[a] for a in itertools.pairwise(path)])
        for path, p in paths.items():
            for c, y in zip(o, path, strict=True):
                want[c] += y * n * p / sum(paths.values())
            for a in itertools.pairwise(path):
                steps[a] += n * p / sum(paths.values())
    part = toxicity._Segments(kinds)
    got = part.expected(emit, m)
    assert np.allclose(got[0], want) and np.allclose(got[1], steps)
    seen = part.seen()
    assert seen[0][[0, 3, 5, 7]].tolist() == [0, 2, 2, 2] and seen[1].tolist() == [[2, 2], [3, 1]]


def test_places_of_features(monkeypatch):
    """Numbers of different surroundings are those of plain sets, with many parts or one."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["Alphabet", "alphabets!", "alpha-beta", "beta", "42", "übermut"]) for _ in range(rnd.randrange(60))) for _ in range(40)] + ["", "beta"]
    want = {n: {} for n in (0, *toxicity.BEGINNINGS)}
    for text in texts:
        tokens = ["", *text.lower().split(), ""]
        for a, token, b in zip(tokens, tokens[1:], tokens[2:], strict=False):
            for f in toxicity.features(token):
                want[len(f) - 1 if f.endswith("*") else 0].setdefault(f, set()).add((a, b))
    for at_once in (1, 50, toxicity.PLACES_AT_ONCE):
        monkeypatch.setattr(toxicity, "PLACES_AT_ONCE", at_once)
        places = toxicity._Places(texts)
        assert all(places.counts(n) == {f: len(s) for f, s in want[n].items()} for n in want)
    assert toxicity._Places([]).counts(0) == {} == toxicity._Places(["", " 1 "]).counts(4)


def test_toxicity_of_a_sample_without_tokens():
    model = toxicity.train([(1, ""), (0, " "), (0, "")])
    assert 0 < toxicity._Tagger(model).score("any text") < 1


def test_chain_stretches_equal_single_steps():
    chain = toxicity.Chain(np.array([-2.0, 1.0, 2.0, 3.0, 3.0, 3.0]), np.array([[1.0, -1.0], [-0.5, 0.5]]))
    obs = [0, 0, 2, 0, 0, 0, 0, 1, 3, 0]
    at = [2, 7, 8]
    alpha, forward = np.ones(2), []
    for o in obs:
        alpha = (alpha @ np.exp(chain.step)) * np.array([1, np.exp(chain.emit[o])])
        forward.append(alpha := alpha / alpha.sum())
    beta, want = np.ones(2), [0.0] * len(obs)
    for i in range(len(obs) - 1, -1, -1):
        both = forward[i] * beta
        want[i] = both[1] / both.sum()
        beta = np.exp(chain.step) @ (np.array([1, np.exp(chain.emit[obs[i]])]) * beta)
    assert np.allclose(chain.marginals(at, [obs[i] for i in at], len(obs)), [want[i] for i in at])


def test_packing(docs, none):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert 49407 in ids[len(TEXTS) - 1]
    seen, sequences = {i: [] for i in ids}, {}
    for r in packing.pack(docs, path).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(array("I", own).tobytes()))
        seen[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, whole in [*((seen[i], len(ids[i])) for i in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == whole if whole else at <= 2048
    assert packing.pack(none, path).count() == 0


def test_special_tokens_as_text(spark):
    """The strings of special tokens are ordinary text where that is asked for."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    made = shards.ShardSet.write(spark.createDataFrame([(1, TEXTS[-1])], "doc_id long, text string"), P.path("byte_bpe_50k.json"), special_text=True)
    want = [*library.encode(TEXTS[-1], add_special_tokens=False).ids, 0]
    assert made.read().first().ids_crc32 == zlib.crc32(array("I", want).tobytes())


def _squares(packer, window, leave, reach):
    c = packer.counts.copy()
    for h in leave:
        c[h] -= h > 0
    for h in reach:
        c[h] += h < window
    return int((c * c).sum())


def test_sum_of_squares_rule():
    rnd = random.Random(6)
    packer = packing.Packer(32)
    for k in range(400):
        n = rnd.randrange(1, 32)
        options = [h for h in range(0, 33 - n) if h == 0 or packer.counts[h]]
        h, growth = packer.level(n)
        now = _squares(packer, 32, [], [])
        assert now + growth == _squares(packer, 32, [h], [h + n]) == min(_squares(packer, 32, [h], [h + n]) for h in options)
        cuts = [_squares(packer, 32, [h], [h + n - 32]) for h in range(33 - n, 32) if packer.counts[h]]
        assert not cuts or now + packer.cut_level(n)[1] == min(cuts) + packing.CUT
        packer.add(k, array("I", [0] * n).tobytes())


@pytest.mark.parametrize("sizes", [[1500], [1025], [3], [700, 1100, 1900], list(range(1, 2048, 7))])
def test_packing_is_bounded_and_pads_nothing(sizes):
    """Windows don't pile up, whatever the lengths are; each token is in one piece, and only powers of two are shorter."""
    rnd = random.Random(2)
    packer, want = packing.Packer(2048), {}
    for k in range(6000):
        want[k] = rnd.choice(sizes)
        packer.add(k, array("I", range(want[k])).tobytes())
        assert packer.counts.max() <= packing.CUT
    packer.finish()
    seen, fill = {}, {}
    for doc, start, length, crc, tokens, sequence, offset in packer.rows:
        assert tokens == want[doc] and crc == zlib.crc32(array("I", range(start, start + length)).tobytes())
        seen[doc], fill[sequence] = seen.get(doc, 0) + length, fill.get(sequence, 0) + length
    assert seen == want and all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    assert sum(n < 2048 for n in fill.values()) <= 11


def test_language(spark, docs, none):
    rnd = random.Random(8)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model))
    assert all(found[i].lang_pred == lang and found[i].score > 0.5 for i, _, lang in rows)
    odd = by_id(langid.identify(docs, model))
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 9, 10))
    assert odd[5].score < 0.3  # a script that no learned language has
    assert langid.identify(none, langid.learn(none.withColumn("lang", F.lit("x")))).count() == 0
    assert langid.keep_known(docs, model).columns == docs.columns


def test_word_probabilities():
    """The probabilities of all words of up to four of the letters learned are at most 1 together, and most of it."""
    from itertools import product

    model = langid.train([("aa", "abab abba baab cab")])
    words = ["".join(w) for n in range(1, 5) for w in product("abc", repeat=n)]
    total = np.exp(model.score_words(words)[0][:, 0]).sum()
    assert 0.5 < total <= 1.0


def test_shards(docs, none, spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert 50256 in library.encode(TEXTS[-1], add_special_tokens=False).ids
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "null key"), (7, "second of a key")], "doc_id long, text string"))
    made = shards.ShardSet.write(more, path)
    at, rows = 0, sorted(made.read().collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == sorted([*range(len(TEXTS)), 7, None], key=lambda k: -1 if k is None else k)
    for r in rows:
        texts = ["null key"] if r.key is None else [TEXTS[r.key] or "", *(["second of a key"] if r.key == 7 else [])]
        crcs = {zlib.crc32(array("I", [*library.encode(t, add_special_tokens=False).ids, 0]).tobytes()) for t in texts}
        assert r.start == at and r.ids_crc32 in crcs
        at += r.n_tokens
    got = made.lookup(spark.createDataFrame([(4,), (7,), (99999,), (-5,)], "doc_id long"), "doc_id").collect()
    assert sorted(r.key for r in got) == [4, 7, 7]
    assert next(r.ids for r in got if r.key == 4) == [*library.encode(TEXTS[4], add_special_tokens=False).ids, 0]
    assert shards.ShardSet.write(none, path).read().count() == 0
    with pytest.raises(Exception, match="stands for null"):
        shards.ShardSet.write(spark.createDataFrame([(-(1 << 63), "x")], "doc_id long, text string"), path)


def test_shards_follow_bytes(spark, monkeypatch):
    """Shards are as many as the bytes ask for, whatever the session's partitions are, and all rows of a hot key are read back."""
    monkeypatch.setattr(shards, "SHARD_BYTES", 2000)
    rows = [(5 if i % 3 == 0 else i, f"text number {i % 40} " * 3) for i in range(300)]
    made = shards.ShardSet.write(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"))
    assert len(made.shards) > 6
    assert sorted(r.key for r in made.read().collect()) == sorted(i for i, _ in rows)


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
    assert 0 < out.count() <= docs.count()
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == out.count()


def _alike_classes(texts):
    """Smallest index reachable by pairs of five-word Jaccard similarity of at least 0.8, by comparing all pairs."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of] if low != high else of
    return dict(enumerate(of))


def test_near_copies(spark, none, monkeypatch):
    """The stage leaves one document of each group of near copies, those of many changed bits among them."""
    import corpus_pipeline

    rnd = random.Random(5)
    texts = [t for t in TEXTS if len(t or "") < 9000]
    for _ in range(12):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((12, 60, 400)))]
        texts.append(" ".join(words))
        for changed in (0.005, 0.01, 0.02, 0.03, 0.08):
            texts.append(" ".join(w if rnd.random() > changed else "other" for w in words))
    common = [f"c{i}" for i in range(300)]
    texts += [" ".join([*common, f"end{i}"]) for i in range(40)]  # a large group
    monkeypatch.setattr(near, "SLICE", 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(_alike_classes(texts).values())
    assert corpus_pipeline.drop_near_copies(spark, none, "").count() == 0


@pytest.mark.parametrize("deduplicate", [near.deduplicate, simhash.deduplicate])
def test_one_row_of_each_component(spark, deduplicate):
    """Each component keeps one row, also where ids are repeated or null."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, d), (None, d), (5, d), (None, "alone")]
    kept = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(1, a), (2, b), (4, c), (5, d), (None, "alone")], key=str)


def test_redaction_of_overlapping_spans(spark):
    """No part of a span that was found stays."""
    texts = ["+1 555 010 2030.bob@mail.com is gone", "call +1 555 010 2030, bob@mail.com", "1.2.3.4@mail.com x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = [r.text for r in sorted(pii.redact(df).collect())]
    assert clean == ["<PHONE><EMAIL> is gone", "call <PHONE>, <EMAIL>", "<EMAIL> x"]


def test_pipeline_against_plain_version(spark, tmp_path):
    """run() over planted rows gives what plain decisions on each document give."""
    import corpus_pipeline

    rnd = random.Random(11)
    words = {lang: ["".join(rnd.choice(letters) for _ in range(5)) for _ in range(300)] for lang, letters in (("aa", "abcdefg"), ("bb", "hijklmno"))}
    bad = ["Zorkface!", "zorkhead", "quibnit"]
    rows, labels = [], []
    for i in range(300):
        lang = ("aa", "bb")[i // 2 % 2]
        text = [rnd.choice(words[lang]) for _ in range(60)]
        for _ in range(4 * (i % 4 == 0)):
            text[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(i % 4 == 0)))
    unlearned = (i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5 == 0)
    planted = {}

    def plant(kind, text):
        planted.setdefault(kind, []).append(i := next(unlearned))
        rows.append((i, text, "aa"))

    for k in (1, 2, 3, 5):
        text = rows[k][1].split()
        plant("toxic", " ".join([*text[:20], *bad, *text[20:40], *bad]))
        plant("near", " ".join([*text[:30], "egg", *text[31:]]))
        plant("far", " ".join([*text[:15], "egg", *text[16:45], "bed", *text[46:]]))
        plant("foreign", "日本語の文章 です。 テスト データ " * 5)
        plant("personal", " ".join([*(rnd.choice(words["aa"]) for _ in range(60)), f"bob{k}@mail.com", f"+1 555 010 203{k}.ann@mail.com"]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labelled = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))

    texts = {i: t for i, t, _ in rows}
    scores = by_id(toxicity.score(docs, toxicity.learn(docs, labelled)))
    left = sorted(i for i in texts if scores[i].score < 0.7)
    clean = docs.where(F.col("doc_id").isin(left))
    said = by_id(langid.identify(clean, langid.learn(clean)))
    left = [i for i in left if said[i].lang_pred != "und" and said[i].score >= 0.3]
    left = [left[k] for k in sorted(set(_alike_classes([texts[i] for i in left]).values()))]
    assert not {*planted["toxic"], *planted["near"], *planted["foreign"]} & {*left}
    assert {*planted["far"], *planted["personal"]} <= {*left} and len([i for i in left if i < 300]) > 200
    spans = by_id(pii.detect(docs.where(F.col("doc_id").isin(left))))
    path, ids = P.path("word_bpe_49k.json"), {}
    library = Tokenizer.from_file(path)
    for i in left:
        out, past = "", 0
        for at, back, kind in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans[i].spans.split(",") if x)):
            if -back > past:
                out, past = out + texts[i][past:at] + f"<{kind.upper()}>", -back
        ids[i] = [*library.encode(out + texts[i][past:], add_special_tokens=False).ids, 1]
        assert i not in planted["personal"] or out.endswith("<EMAIL> <PHONE><EMAIL>") and past == len(texts[i])

    seen = {i: [] for i in left}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(array("I", own).tobytes()))
        seen[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(seen[i]) == list(range(len(ids[i]))) for i in left)


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_registered_queries_run(spark, name):
    """Each registered query, with its own parameters, says something of every row of its table."""
    from sluice.llm import registry

    query = next(f for k, f in registry.queries().items() if k.startswith(name))
    table, key, out = {"op5_": ("pages", "page_id", "page_id"), "op6_": ("embeddings", "vec_id", "query_id")}.get(name, ("documents", "doc_id", "doc_id"))
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    wanted = {r[0] for r in rows.where("vec_id % 50 = 0" if name == "op6_" else "true").select(key).collect()}
    found = query(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in found.select(out if out in found.columns else found.columns[0]).collect()} == wanted


@pytest.mark.parametrize("n, d", [(2000, 64), (1000, 128)])
def test_nearest_of_vectors_without_clusters(n, d):
    """Widening goes on until the nearest are found, however many are verified for it."""
    x = np.random.default_rng(9).normal(size=(n, d))
    index = ann.BlockIndex(np.arange(n), x, 5)
    norms, hits = np.linalg.norm(x, axis=1), 0
    for q in range(0, n, 50):
        s = x @ x[q] / norms
        s[q] = -np.inf
        hits += len({i for i, _ in index.search([q], x[q : q + 1])[0]} & {*np.argsort(-s)[:5].tolist()})
    assert hits / (5 * len(range(0, n, 50))) >= 0.95


def test_cosines_of_huge_and_tiny_vectors():
    """Squares beyond the range of doubles do no harm."""
    x = np.array([[3.0, 4.0], [4.0, 3.0], [-3.0, 4.0], [3.0, 4.0]]) * np.array([1e200, 1e-200, 1e300, 1.0])[:, None]
    index = ann.BlockIndex(np.arange(4), x, 3)
    assert [(i, round(s, 12)) for i, s in index.search([3], x[3:])[0]] == [(0, 1.0), (1, 0.96), (2, 0.28)]
