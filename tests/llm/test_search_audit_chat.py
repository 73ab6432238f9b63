"""Search, source audit and chat formatting on awkward rows, against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicledger.llm import chat_formatting as C
from civicledger.llm import lexical_search as S
from civicledger.llm.common import folding, terms_of
from civicledger.llm.source_audit import audit_sources

DOCS = "doc_id long, text string, lang string, source string, SCORE string, rank string, n long"
rng = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(60)] + ["Été", "x9"]


def some(n: int) -> str:
    return " ".join(WORDS[int(i)] for i in rng.zipf(1.4, n) % len(WORDS))


ROWS = [(i, some(int(rng.integers(1, 80))), "en" if i % 3 else None, f"s{i % 5}", "x", None, 1) for i in range(400)]
ROWS += [(None, some(30), "en", "s1", "x", None, 1), (None, None, None, None, None, None, None), (500, "", "fr", "s0", None, None, None), (501, "... !!", "fr", "s1", None, None, None)]
ROWS += [(7, ROWS[7][1], "en", "s2", None, None, None)] * 2 + [(600, " ".join(["W1 w2,w3"] * 4000), "en", "s9", None, None, None)]
ITEMS = [(1, "w1 w2 W2 x9"), (1, "w1 w2 W2 x9"), (1, "w40 été"), (2, None), (3, ""), (4, "nowhere"), (None, "w3 w59 w1"), (5, " ".join(WORDS))]


def test_terms_of_parts():
    text = ("Ab-" * 50 + "c9 Été " + "z" * 30).encode()
    for digits, pattern in ((True, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (False, rb"[^\x00-\x60\x7B-\x7F]+")):
        want = re.findall(pattern, text.lower())
        for part in (1, 2, 7, 1000):
            assert [w for p in terms_of(text, folding(digits), part) for w in p] == want


def ranked(rows, items, k):
    """Every item (id, text) against every document, by the definition."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    docs = [(r[0], Counter(find(r[1]))) for r in rows]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in {i for i in items if i[1] is not None}:
        scores = []
        for doc, c in docs:
            m = 10 + 90 * c.total() * n // total if total else 10
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(find(text)) if w in c)
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket,k", [(1, 3), (4, 10), (64, 10)])
def test_search_against_all_scores(spark, bucket, k, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_DOCS", 90)
    monkeypatch.setattr(S, "BLOCK_TERMS", 40)  # several blocks
    docs, items = spark.createDataFrame(ROWS, DOCS).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = S.search_documents(docs, items, k=k, bucket=bucket).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == ranked(ROWS, ITEMS, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.filter("text = ''"))):
        got = S.search_documents(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_treap_is_ordered_and_prunes():
    lengths = np.full(4096, 50, np.int64)
    docs = np.arange(0, 4096, 2, dtype=np.int32)
    counts = rng.integers(1, 4, len(docs))
    counts[700] = 900
    trees = S.Treaps(lengths, np.zeros(len(docs), np.int32), docs, counts.astype(np.int64), {0: 1000}, 4096, 4096 * 50, bucket=1)

    def walk(v, lo, hi, top):
        if v < 0:
            return 0
        assert lo <= trees.at[v] < hi and trees.tops[v] <= top
        return 1 + walk(trees.left[v], lo, trees.at[v], trees.tops[v]) + walk(trees.right[v], trees.at[v] + 1, hi, trees.tops[v])

    import sys
    sys.setrecursionlimit(10_000)
    assert walk(trees.roots[0], 0, 4096, math.inf) == len(docs)
    best = []
    assert trees.search([0], best, 1, list(range(4096)), 0) == 1 and -best[0][2] == 1400


def audited(rows, least, top):
    find = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = find(text)
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        vocab = sorted(w for w in df[lang] if df[lang][w] >= least)
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])

        def p(c):
            size = sum(c[w] for w in vocab) + 5 * len(vocab)
            return {w: 1 + 10**9 * (c[w] + 5) // size for w in vocab}

        shares, q = {s: p(n[lang, s]) for s in sources}, p(whole)
        for s in sources:
            far = [(-sum(abs(shares[s][w] - shares[o][w]) for w in vocab), o.encode()) for o in sources if o != s]
            own = [(q[w] - shares[s][w], w.encode()) for w in vocab if n[lang, s][w] and shares[s][w] > q[w]]
            for part, found in (("pair", sorted(far)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 5), (30, 50), (10_000, 50)])
def test_audit_against_all_terms(spark, least, top, monkeypatch):
    from civicledger.llm import source_audit

    monkeypatch.setattr(source_audit, "HELD", 20)
    got = audit_sources(spark.createDataFrame(ROWS, DOCS).repartition(3), least_docs=least, top=top).collect()
    assert sorted(map(tuple, got)) == audited(ROWS, least, top)


def test_audit_of_nothing_and_of_large_counts(spark):
    from civicledger.llm.source_audit import _share

    assert audit_sources(spark.createDataFrame([], DOCS)).count() == 0
    big = 4 * 10**17
    got = spark.range(1).select(_share(F.lit(big).cast("long"), F.lit(3 * big).cast("long"), F.lit(7).cast("long"), 5, 10**9)).first()[0]
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 35)


CONTROL = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nno"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (1, None, "system", "<~ [~~ <<SYS>> <<~/SYS>>"),
    (2, 0, None, None), (3, 0, "", ""), (4, 5, "assistant", ""), (4, 6, "tool<|end_header_id|>", "x\n\n<"), (4, 7, "assistant", "É[" + "[INST]" * 3 + "<<<s>~"), (None, 1, "assistant", "a"), (None, 2, "user", CONTROL),
    (5, 0, "user", "<|eot_" + "id|>"), (6, 0, "assistant", "w " * 60000 + CONTROL), (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL),
]
CHAT = "conv_id long, turn long, role string, text string, formatted string, LEVEL int"


def told(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("template", [C.Template(), C.Template("<s>[INST]", "[/INST]", "</s>", "\\"), C.Template("<|im_start|>", "<<SYS>>\n", "<|im_end|>\n")])
def test_chats_are_read_back(spark, template):
    convs = spark.createDataFrame([(*t, "x", 9) for t in TURNS], CHAT)
    got = C.digests(convs, template=template).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == told(TURNS) and len(got) == len(told(TURNS))
    for r in C.format_conversations(convs, template=template).collect():
        own = sum(t[0] == r.conv_id for t in TURNS)
        assert r.formatted.count(template.start) == r.formatted.count(template.end) == own
        loss = b"".join(r.formatted.encode()[s.start : s.start + s.length] for s in r.loss_spans).decode()
        assert not any(c in loss for c in template.controls)
    assert C.digests(spark.createDataFrame([], CHAT), template=template).count() == 0


def test_chats_where_texts_and_marks_meet(spark):
    """A text's end and the next mark make a control string together: everything is escaped then."""
    t = C.Template("<a>", "<b>", "]<c>", "~", ("<a>", "<b>", "<c>", "[]<"))
    turns = [(1, 0, "user", "x["), (1, 1, "assistant", "y"), (2, 0, "user", "x")]
    convs = spark.createDataFrame([(*x, None, 0) for x in turns], CHAT)
    got = C.digests(convs, template=t).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == told(turns)


def test_chats_that_are_none(spark):
    t = C.Template()
    bad = ["x", t.start, t.start + "user" + t.end, "x" + t.start + "u" + t.says + "a" + t.end, t.start + "u" + t.says + "a" + t.end + "b", t.start + "u" + t.says + "a</s>" + t.end]
    assert all(r[0] is None for r in spark.createDataFrame([(b,) for b in bad], "f string").select(t.parse(F.col("f"))).collect())
    for wrong in (dict(sign="<"), dict(sign="~~"), dict(end="done")):
        with pytest.raises(ValueError):
            C.Template(**wrong)


def test_native_plan(spark):
    """op13 has no Python in its plan."""
    convs = spark.createDataFrame([(*t, "x", 9) for t in TURNS], CHAT)
    assert "Python" not in C.format_conversations(convs)._jdf.queryExecution().toString()
