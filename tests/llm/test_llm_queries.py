"""The registered queries over a whole small table, against SQL or a plain restatement of their contract."""

import hashlib
import re

import pytest
from conftest import SMALL, rows_of

from lumenspan.llm import queries as Q


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT * FROM documents ORDER BY doc_id").fetchdf()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = rows_of(Q.queries()[name](spark, SMALL).toPandas())
    assert got == rows_of(duck.execute(Q.oracle_sql()[name]).fetchdf())


def _rendered(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))


def _spans(documents, found, base, kinds):
    got = found.set_index("doc_id")
    for doc, text in zip(documents.doc_id, documents.text):
        spans, row = base(text), got.loc[doc]
        assert row.base_sha256 == hashlib.sha256(_rendered(spans, kinds).encode()).hexdigest()
        for k, kind in enumerate(kinds):
            assert row[f"n_{kind}"] == sum(s[0] == k for s in spans)
        assert set(filter(None, _rendered(spans, kinds).split(","))) <= set(row.spans.split(","))


def test_op1_base(spark, documents):
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"""({names}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

    def base(text):
        out = [(0, m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        return out + [(2, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]

    _spans(documents, Q.op1_secrets(spark, SMALL).toPandas(), base, ("assign", "access", "hex"))


def test_op5_base(spark, documents):
    from lumenspan.llm.pii import luhn

    def base(text):
        digits = lambda s: re.sub("[^0-9]", "", s)
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]

    _spans(documents, Q.op5_personal_data(spark, SMALL).toPandas(), base, ("email", "ip", "card", "phone"))


def test_op3_held_out(spark, duck):
    import zlib

    got = Q.op3_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    labels = duck.execute("SELECT doc_id, toxic, lang FROM '/root/testdata/sf0.01/labels.parquet' JOIN '/root/testdata/sf0.01/documents.parquet' USING (doc_id)").fetchdf()
    judged = got.merge(labels, on="doc_id")
    held, toxic = judged[judged.held_out], judged[judged.toxic == 1]
    assert held[held.toxic == 1].predicted.mean() >= 0.9
    assert held[held.toxic == 0].predicted.mean() <= 0.02
    for _, part in toxic.groupby("lang"):
        assert part.predicted.mean() >= 0.75


def test_op4_counts_and_verdicts(spark, documents, duck):
    from collections import Counter

    got = Q.op4_quality_rules(spark, SMALL).toPandas().set_index("doc_id")
    for doc, text in zip(documents.doc_id, documents.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        repeated = len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)})
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated)
        row = got.loc[doc]
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == expected
        assert row.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w))
        assert not (row.base_failed and row.kept)
    labels = duck.execute("SELECT * FROM labels").fetchdf().set_index("doc_id")
    judged = got[~got.base_failed].join(labels, how="inner")
    assert judged[judged.quality == 1].kept.all()
    assert judged[judged.quality == 0].kept.mean() < 0.2


def test_op9_in_several_blocks(spark, duck, monkeypatch):
    """Every document with an id divisible by 20 is a query, also when they go in several blocks to small shards."""
    from lumenspan.llm import search

    expected = duck.execute(Q.oracle_sql()["op9_topk_search"]).fetchdf()
    assert expected.query_id.nunique() == duck.execute("SELECT count(*) FROM documents WHERE doc_id % 20 = 0").fetchone()[0]
    monkeypatch.setattr(search, "BLOCK_TERMS", 500)
    monkeypatch.setattr(search, "PACK_TERMS", 100)
    monkeypatch.setattr(search, "SHARD_CHARS", 20_000)
    assert rows_of(Q.op9_topk_search(spark, SMALL).toPandas()) == rows_of(expected)


def test_op7_against_all_pairs(spark, documents):
    got = Q.op7_near_duplicates(spark, SMALL).toPandas().set_index("doc_id")
    expected = components(zip(documents.doc_id, documents.text))
    for doc, (n, component) in expected.items():
        assert tuple(got.loc[doc][["n_shingles", "component_id"]]) == (n, component)
        assert got.loc[doc].kept == (doc == component)


def components(texts):
    """doc: (set size, component) by comparing the sets of all documents."""
    sets = {}
    for doc, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    home = {d: d for d in sets}

    def root(d):
        while home[d] != d:
            d = home[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    home[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_op10_against_library(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = Q.op10_bpe(spark, SMALL).toPandas().set_index("doc_id")
    for doc, text in zip(documents.doc_id, documents.text):
        ids = t.encode(text, add_special_tokens=False).ids
        row = got.loc[doc]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_against_every_passage(spark, documents):
    """The matcher's bounds lose nothing: all passages of whole texts are tried, and the query tells the same."""
    from collections import Counter

    from lumenspan.llm import licenses as L

    matcher = L.Matcher()
    rows = [(d, t) for d, t in zip(documents.doc_id, documents.text) if ("icense" in t or "rights reserved" in t) and len(t) < 2500][:12]
    rows += [(-1, "All rights reserved"), (-2, ""), (-3, "Released under the MIT License; all rights reserved."), (-4, L._MIT.replace("substantial", "considerable"))]
    got = {r.doc_id: r for r in L.summary(spark.createDataFrame([(int(d), t) for d, t in rows], "doc_id long, text string")).collect()}
    assert len(rows) >= 8
    for doc, text in rows:
        words = L.normalised(text)
        passages = []
        for i, (size, bigrams) in enumerate(zip(matcher.sizes, matcher.bigrams)):
            best = {}
            for a in range(len(words)):
                own = Counter()
                for b in range(a + 2, min(len(words), a + 2 * size + 2) + 1):
                    own[words[b - 2], words[b - 1]] += 1
                    dice = 2 * (own & bigrams).total() / (own.total() + size)
                    if dice >= L.THRESHOLD - 1e-12 and (a not in best or dice > best[a][3] + 1e-12):
                        best[a] = (i, a, b, dice)
            passages += best.values()
        kept = []
        for m in sorted(passages, key=lambda m: (-round(m[3], 12), -(m[2] - m[1]), m[1], m[0])):
            if all(m[2] <= k[1] or k[2] <= m[1] for k in kept):
                kept.append(m)
        kept.sort(key=lambda m: m[1])
        assert got[doc].licences == ",".join(f"{matcher.templates[i][0]}:{a}:{b}" for i, a, b, _ in kept)
        assert got[doc].best_dice == pytest.approx(max((m[3] for m in kept), default=0.0))


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "bpe"]
    docs, columns = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    kept = {}
    for name, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        kept[name] = docs.toPandas()
    assert 0.5 * len(documents) < len(kept["toxicity"]) < len(documents)
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    after = components(zip(kept["line_dedup"].doc_id, kept["line_dedup"].text))
    assert sorted(kept["near_dedup"].doc_id) == sorted(d for d, (n, c) in after.items() if d == c)
    final = P.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert sorted(final.doc_id) == sorted(kept["source_mix"].doc_id)
    whole = P.run(spark, SMALL).toPandas()
    assert rows_of(whole) == rows_of(final)
