"""Fill-in-middle, conversation repair and forced-boundary BPE against plain Python."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from taproot.llm import bpe, conversations, fill_middle

WORD = public_tokenizers.path("word_bpe_49k.json")
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle


def plain_fill_in_middle(doc_id, text):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, rows):
    rnd = random.Random(3)
    letters = " \t\n\v\f\r\x1c\x85 aé日🙂<P>"
    made = rows + [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))) for i in range(100, 600)]
    made += [(600, "<P> a"), (601, "a <S>"), (602, "x <M y"), (603, "a <" * 30), (604, "<S" * 9 + " b")]
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in made], "text string, doc_id long, output string, n int").repartition(3)
    got = fill_middle.fill_in_middle(docs)
    back = got.select("*", fill_middle.restored(got.output, got.form).alias("restored")).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key) == sorted(((i, *plain_fill_in_middle(i, t or "")) for i, t in made), key=key)
    assert sorted(r.restored for r in back) == sorted(t or "" for _, t in made)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    other = fill_middle.fill_in_middle(docs, seed=7, rate=100, suffix_first=0).collect()
    assert {r.form for r in other if r.output and r.doc_id and 100 <= r.doc_id < 600 and not re.search("<[PSM]>", r.output[3:])} <= {"plain", "psm"}


def test_fill_in_middle_of_nothing(none):
    assert fill_middle.fill_in_middle(none).count() == 0


def test_ranked_bits():
    rnd = random.Random(1)
    for size in (1, 2, 63, 64, 65, 1000):
        bits = rnd.getrandbits(size) | 1 << size - 1
        places = [i for i in range(size) if bits >> i & 1]
        assert [fill_middle.select(bits, k, size) for k in range(len(places))] == places


# --- conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(turns):
    """All edits of a conversation, state by state, with whole outcomes compared."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in turns:
        own = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", ())}

    def legal(roles):
        return re.fullmatch("(s|s?(ua)*u?)?", roles)

    def kept(found, new):
        """Of the roles said so far, only whether there are any, and the last, matter."""
        roles = short(new[0])
        old = found.get(roles)
        if legal(new[0]) and (old is None or new[1][:2] < old[:2]):
            found[roles] = new[1]

    def short(roles):
        return roles if len(roles) < 4 else ("s" if roles[0] == "s" else "") + ("ua" if roles[-1] == "a" else "uau")

    def with_inserts(found):
        for _ in range(3):
            for roles, (cost, audit, said) in list(found.items()):
                for role in ("user", "assistant"):
                    kept(found, (roles + role[0], (cost + 2, audit + "I", (*said, f"{role}:"))))
        return found

    for (_, _, role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for roles, (cost, audit, said) in with_inserts(best).items():
            kept(after, (roles, (cost + 3, audit + "D", said)))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                kept(after, (roles + (role[:1] or "?"), (cost + late, audit + "K", (*said, f"{role}:{text}"))))
                for r in ("user", "assistant"):
                    kept(after, (roles + r[0], (cost + 2 + late, audit + "R", (*said, f"{r}:{text}"))))
        best = after
    cost, audit, said = min(v for k, v in with_inserts(best).items() if re.fullmatch("(s?(ua)+)?", k))
    known = [t for _, t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(said)))


def conversation_rows():
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "open end", "", " \n", None, "What?", "Yes. "]
    rows = []
    for conv in range(120):
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, None if rnd.random() < 0.05 else turn * rnd.choice((1, 1, 1, 2)), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(texts)))
    rows += [(None, t, "user", f"null {t}.") for t in range(5)] + [(500, 3, "user", "Again.")] * 7 + [(501, None, "system", "Only.")]
    rows += [(502, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(900)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(t, "x", x, c, r) for c, t, r, x in conversation_rows()]
    return spark.createDataFrame(rows, "turn long, run string, text string, conv_id long, role string").repartition(3)


def expected(rows):
    by_conv = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        by_conv[r[0]].append(r)
    return {c: plain_repair(t) if t else (0, 0, 0, 0, 0, 0, "", sha("")) for c, t in by_conv.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("run, fan", [(4096, 32), (5, 3)])
def test_conversation_repair(spark, talks, tmp_path, monkeypatch, run, fan):
    monkeypatch.setattr(conversations, "RUN", run)
    monkeypatch.setattr(conversations, "FAN", fan)
    talks.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = expected(conversation_rows())
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    if run == 4096:
        c = duckdb.connect()
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert {r[0]: r[1:] for r in c.sql(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({conversations.ORACLE_SQL})").fetchall()} == want


def test_no_conversations(spark, talks, tmp_path):
    talks.limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert conversations.op12_conversation_repair(spark, str(tmp_path)).collect() == []


def test_products_associate():
    rnd = random.Random(2)
    for _ in range(200):
        kinds = [rnd.choice("xsuaoSUAO") for _ in range(rnd.randrange(1, 12))]
        one = conversations.product("".join(kinds))
        cut = rnd.randrange(len(kinds) + 1)
        assert one == conversations.times(conversations.product("".join(kinds[:cut])), conversations.product("".join(kinds[cut:])))
    assert conversations.power(conversations.turn_matrix("x"), 9) == conversations.product("x" * 9)


# --- BPE


def library(text):
    t = Tokenizer.from_file(WORD)
    ids = t.encode(text, add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def odd_texts():
    rnd = random.Random(4)
    letters = "abz ,.'sté日本́ \tΣİ🙂1\n<|"
    texts = ["<|endoftext|>a<|startoftext|> b", "don't it'll 'sx", "日本語" * 200, "ab" * 700, "aab" * 300, "ﬁn x", "\x00\x7f\x80", "É,Ç. Ü!", "<|endoftext|"]
    return texts + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(800)]


def test_bpe(spark, rows):
    made = rows + list(enumerate(odd_texts(), 1000))
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in made], "text string, doc_id long, ids string, n_tokens int").repartition(3)
    got = bpe.decoded(bpe.encoded(docs, WORD), WORD).collect()
    t = Tokenizer.from_file(WORD)
    want = []
    for i, text in made:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)))
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=key) == sorted(want, key=key)


def test_bpe_of_nothing(none):
    assert bpe.decoded(bpe.encoded(none, WORD), WORD).count() == 0


def test_no_token_reaches_over_a_cut():
    e = bpe.ForcedBoundaries(WORD)
    joined = e.joined
    assert 0 < joined[:, :0x20].sum() + joined[:, 0x21:].sum() < 65536 / 4
    asked = []
    e._merged, plain = (lambda f: asked.append(f) or plain(f)), e._merged
    e.fragments.learn = e._merged
    e.encode(pa.array(["qzqxj 日本語 wörter,xx"]))
    assert len(asked) > 5 and any(not f.endswith(b" ") for f in asked)
    assert all(joined[a, b] for f in asked for a, b in itertools.pairwise(f))


def test_long_fragments_merge_as_short_ones(monkeypatch):
    e, texts = bpe.ForcedBoundaries(WORD), pa.array(odd_texts())
    short = e.encode(texts)
    monkeypatch.setattr(bpe, "KEPT", 1)
    long = bpe.ForcedBoundaries(WORD).encode(texts)
    assert short[0] == long[0] and (short[1] == long[1]).all()
    monkeypatch.undo()
    few = bpe.ForcedBoundaries(WORD, memo=4).encode(texts)
    assert short[0] == few[0] and np.array_equal(short[1], few[1])
