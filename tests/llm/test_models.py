import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import corpus
from tidemill.llm import language_id as L
from tidemill.llm import mixing as M
from tidemill.llm.chat import format_chats
from tidemill.llm.nearest import nearest
from tidemill.llm.secrets import scan_secrets


# Language ID ---------------------------------------------------------------------------------------------------------

def all_segmentations(s, p, unknown):
    """Sum over every way to cut s into pieces."""
    if not s:
        return 1.0
    total = 0.0
    for j in range(1, len(s) + 1):
        if s[:j] in p:
            total += p[s[:j]] * all_segmentations(s[j:], p, unknown)
    if s[0] not in p:
        total += unknown * all_segmentations(s[1:], p, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"])}
    rng = np.random.default_rng(1)
    prob = rng.dirichlet(np.ones(len(pieces) + 1), size=2)
    model = L.Model(["x", "y"], np.log(prob), np.log([0.5, 0.5]), pieces)
    words = ["a", "ab", "abab", "bca", "aabba", "ccc"]
    scores = model.word_scores(words)
    for i, w in enumerate(words):
        for k in range(2):
            want = all_segmentations("▁" + w, {p: prob[k, j] for p, j in pieces.items()}, prob[k, -1])
            assert scores[i, k] == pytest.approx(math.log(want), rel=1e-9)
        assert model.long_score(w) == pytest.approx(scores[i])


def test_expectation_maximisation_raises_the_likelihood():
    pieces = {p: i for i, p in enumerate(["▁", "▁t", "t", "h", "e", "th", "he", "the", "▁the"])}
    words, weights = ["the", "tehe", "heth"], np.array([5.0, 2.0, 1.0])
    net = L.Lattice(words, pieces, {p[:i] for p in pieces for i in range(1, len(p))})
    scale = L.SCALE ** np.array([len(p) for p in pieces] + [1])
    p, before = np.full(len(pieces) + 1, 1 / (len(pieces) + 1)), -np.inf
    for _ in range(6):
        ll = float(weights @ np.log(net.forward(p * scale)[np.arange(3), net.size]))
        assert ll >= before - 1e-9
        before, p = ll, net.expected(p * scale, weights, len(p))
        p /= p.sum()


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_predictions_use_text_alone(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs)
    a = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), model).collect()}
    assert a == b


def test_language_of_odd_rows(spark, odd, none):
    model = L.train(odd)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(odd, model).collect()}
    for key in (4, 5, 6, 12):
        assert (key, "und", 0.0) in got
    assert all(r["lang_pred"] != "und" for r in L.identify(odd, model).where("doc_id in (1, 7, 14)").collect())
    assert L.train(none) is None and L.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert L.identify(none, model).count() == 0
    kept = L.keep_known_languages(odd)
    assert kept.columns == odd.columns and not {4, 5, 6, 12} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() == odd.count() - 4 and L.keep_known_languages(none).count() == 0


def test_every_language_is_learnt(spark):
    """One language of very many words does not crowd out small ones; texts are told apart by each language's own syllables."""
    rng = random.Random(2)
    syllables = {f"l{k:02d}": [a + b for a in "bdfgklmnprst"[k % 12 : k % 12 + 3] or "bd" for b in "aeiou"[k // 12 : k // 12 + 2]] for k in range(24)}
    word = lambda own: "".join(rng.choice(own) for _ in range(rng.randint(2, 5)))
    rows = [(i, " ".join(f"{word(syllables['l00'])}{word('abcdefghijklmnopqrstuvwxyz')}" for _ in range(2000)), "l00", "s") for i in range(60)]
    for k, own in list(syllables.items())[1:]:
        rows += [(len(rows) + j, " ".join(word(own) for _ in range(40)), k, "s") for j in range(10)]
    docs = corpus(spark, rows)
    model = L.train(docs)
    assert model.languages == sorted(syllables)
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang <> 'l00'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.7


def test_without_labels_nothing_is_dropped(spark, odd):
    docs = corpus(spark, [(1, "some text", None, "a"), (2, None, None, "a")])
    assert L.train(docs) is None and L.keep_known_languages(docs).count() == 2


def test_long_runs_of_letters_are_learnt_in_stretches():
    assert L.stretches("a" * 150) == ["a" * 60, "a" * 60, "a" * 30] and L.stretches("abc") == ["abc"]


# Mixing --------------------------------------------------------------------------------------------------------------

def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1


def sources_corpus(spark):
    rng = random.Random(4)
    sizes = {"big": 300, "mid": 60, "small": 25, None: 12}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), "en", s))
            i += 1
    return corpus(spark, rows), rows


def brute_exponent(shares, passes, limit):
    low, high = 0.0, 1.0
    worst = lambda a: passes * max(p ** (a - 1) for p in shares) / sum(p**a for p in shares)
    if worst(0.0) <= limit:
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if worst(mid) <= limit else (mid, high)
    return high


def test_mix_meets_the_repetition_limit(spark):
    docs, rows = sources_corpus(spark)
    got = M.mix(docs, 1.0, 2.0).toPandas()
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += words(t)
    whole = sum(totals.values())
    shares = {s: t / whole for s, t in totals.items()}
    a = brute_exponent(shares.values(), 1.0, 2.0)
    z = sum(p**a for p in shares.values())
    cost = {i: words(t) for i, t, _, _ in rows}
    longest = max(cost.values())
    got["s"] = got.source.where(got.source.notna(), None)
    for s, p in shares.items():
        own = got[got.source.isna()] if s is None else got[got.source == s]
        want = p**a / z * whole
        assert want - longest <= own.n_tokens.sum() <= want + 1
        assert own.groupby("doc_id").size().max() <= 2 and own.weight.iloc[0] == pytest.approx(p**a / z, abs=1e-5)
        ids = [i for i, _, _, x in rows if x == s]
        per = Counter(own.doc_id)
        assert max(per.get(i, 0) for i in ids) - min(per.get(i, 0) for i in ids) <= 1  # whole passes and one partial


def test_target_entropy(spark):
    docs, rows = sources_corpus(spark)
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += words(t)
    for target in (0.9, 1.2):
        w = {r["source"]: r["weight"] for r in M.mix(docs, 1.0, None, target).select("source", "weight").distinct().collect()}
        assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(target, abs=1e-4)
    with pytest.raises(ValueError):
        M.mix(docs, 1.0, None, 5.0)
    with pytest.raises(ValueError):
        M.mix(docs, 3.0, 2.0)
    with pytest.raises(ValueError):
        M.mix(docs, 1.0, 2.0, 1.0)


def test_blocks_of_the_mix_follow_the_weights(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 800)
    docs, _ = sources_corpus(spark)
    got = M.mix(docs).toPandas()
    share = got[got.source == "big"].groupby("block").n_tokens.sum() / got.groupby("block").n_tokens.sum()
    assert got.block.nunique() > 5 and share.std() < 0.1


def test_mix_of_odd_rows_and_documents(spark, odd, none):
    assert M.mix(none).count() == 0 and M.mix_documents(none).count() == 0
    out = M.mix_documents(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()}  # each at least once
    most = max(Counter(r["doc_id"] for r in out.collect() if r["doc_id"] not in (None, 7)).values())
    assert most <= 2
    assert M.mix(odd).count() >= 1


# Nearest neighbours --------------------------------------------------------------------------------------------------

def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if q % every:
            continue
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d)]
    return out


def test_nearest_against_all_pairs(spark, monkeypatch):
    import tidemill.llm.nearest as N

    monkeypatch.setattr(N, "CANDIDATE_BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (500, [1.0, 2.0]), (501, [1.0, 2.5]), (None, [1.0] * 8), (405, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, 10, 10).collect())
    want = sorted(brute_nearest(rows, 10, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)
    assert nearest(df.limit(0)).count() == 0


def test_bounds_hold():
    from tidemill.llm.nearest import quantised

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 16))
    codes, scale, norms, errors = quantised(x)
    back = codes * scale[:, None]
    true = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    coded = np.sqrt(((back[:, None] - back) ** 2).sum(axis=2))
    slack = errors[:, None] + errors
    assert (np.abs(true - coded) <= slack + 1e-9).all() and np.allclose(norms, (back**2).sum(axis=1))


# Secrets -------------------------------------------------------------------------------------------------------------

PATTERNS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def brute_spans(text):
    out = []
    for order, (kind, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


SECRET = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def test_base_spans(spark, odd, none):
    extra = ["secret=token: abcdefgh", "PASSWORD: 'hunter2hunter2' api_key=xyz123abc apikey : short", "ſecret=abcdefghi toKen=abcdefghi", "AKIAAKIASHORT AKIA" + "Z9" * 12, "é" * 10 + " token = é", "ab" * 12 + "x" + "0" * 30]
    docs = odd.unionByName(corpus(spark, [(50 + i, t, "en", "s") for i, t in enumerate(extra)]))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in scan_secrets(docs).collect():
        want = brute_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(w[2] for w in want).encode()).hexdigest()
        kinds = Counter(w[3] for w in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(w[2] for w in want) <= set(r["spans"].split(","))
    assert scan_secrets(docs).count() == docs.count() and scan_secrets(none).count() == 0


def test_ownership_tells_examples_from_credentials(spark):
    live, example = "Zx81Qw92Er73Ty64Ui55Op", "EXAMPLEkey1234567890AB"
    rows = [(1, f"token = {live}", "en", "a"), (2, f"see {live} here", "en", "a"), (3, f"nothing Zz99Yy88Xx77Ww66Vv55", "en", "b")]
    rows += [(10 + i, f"api_key = {example}", "en", f"s{i}") for i in range(4)] + [(20, f"bare {example} copy", "en", "q")]
    got = {r["doc_id"]: r for r in scan_secrets(corpus(spark, rows)).collect()}
    assert got[1]["n_live"] == 1 and got[1]["n_copied"] == 0
    assert got[2]["n_added"] == 1 and got[2]["spans"] == "bare:4:26"
    assert got[3]["spans"] == "" and got[20]["spans"] == ""
    assert all(got[10 + i]["n_copied"] == 1 and got[10 + i]["n_live"] == 0 for i in range(4))


def test_bare_tokens_against_all_pairs_and_in_linear_time():
    import time

    from tidemill.llm.secrets import LONG_TOKEN, bare_tokens, base_spans

    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["token=", "ab12cd34ef56ab78", "AKIA", "ABCDEFGH12345678", " ", ".", "0123456789abcdef01234567", "x", "/"]) for _ in range(rng.randint(1, 14)))
        taken = base_spans(text)
        want = [m.span() for m in LONG_TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e, _ in taken) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        assert [(a, b) for _, a, b, _ in bare_tokens(text, taken)] == want
    long = "api_key=abcdef12 Zx81Qw92Er73Ty64Ui55Op " * 30_000
    began = time.process_time()
    assert len(bare_tokens(long, base_spans(long))) == 30_000 and time.process_time() - began < 5


def test_a_null_owner_is_not_the_empty_one(spark):
    got = scan_secrets(corpus(spark, [(1, "token = Zx81Qw92Er73", "en", None), (2, "token = Zx81Qw92Er73", "en", ""), (3, "token = Aa11Bb22", "en", None)])).collect()
    assert {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in got} == {1: (0, 1), 2: (0, 1), 3: (1, 0)}


# Chat formatting -----------------------------------------------------------------------------------------------------

SCHEMAS = {"f": {"properties": {"k": {"type": "integer"}, "z": {"type": "string"}}, "required": ["k"], "additionalProperties": False}}


def calls(*found, content=None):
    return json.dumps({"content": content, "tool_calls": list(found)})


def chat_rows():
    return [
        (1, 0, "user", 'hi "x"\n\x01 é/'), (1, 1, "assistant", calls({"id": "b", "name": "f", "arguments": {"k": 2, "z": "s"}, "depends_on": ["a"]}, {"id": "a", "name": "f", "arguments": '{"z": "q", "k": 1}'}, content="go")),
        (1, 2, "tool", '{"tool_call_id":"b","content":"rb"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"ra"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"r"}'), (1, 5, "tool", '{"tool_call_id":"a","content":"again"}'),
        (2, 0, "tool", '{"tool_call_id":"q","content":"early"}'), (2, 1, "assistant", calls({"id": "q", "name": "g", "arguments": "nope"})), (2, 2, "assistant", calls({"id": "q", "name": "f", "arguments": {"k": "x"}})),
        (3, 0, "assistant", calls({"id": "x", "name": "f", "arguments": {}, "depends_on": ["y"]}, {"id": "y", "name": "f", "arguments": {"k": 1, "w": 2}, "depends_on": ["x"]})),
        (4, 0, "assistant", calls({"id": "late", "name": "f", "arguments": {"k": 1}, "depends_on": ["first"]})), (4, 1, "assistant", calls({"id": "first", "name": "f", "arguments": {"k": 1.5}})),
        (None, None, None, None), (5, 0, "assistant", '{bad "tool_calls"'), (5, 1, "user", None), (5, 1, "user", None),
    ]


@pytest.fixture(scope="module")
def chats(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in chat_rows()], "conv_id long, turn long, role string, text string, link int, i string")
    return {(r["conv_id"], r["turn"]): r for r in format_chats(df, SCHEMAS).collect()}, format_chats(df, SCHEMAS).count(), format_chats(df.limit(0)).count()


def test_every_message_comes_back(chats):
    rows, n, none = chats
    assert n == len(chat_rows()) and none == 0


def test_canonical_json(chats):
    rows, _, _ = chats
    for conv, turn, role, text in chat_rows():
        if rows[conv, turn]["link"] == "plain":
            body = {k: v for k, v in (("content", text), ("role", role)) if v is not None}
            assert json.loads(rows[conv, turn]["message_json"]) == body
            assert rows[conv, turn]["message_json"].replace("\\u0001", "") == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("\\u0001", "")
    want = {"content": "go", "role": "assistant", "tool_calls": [{"arguments": {"k": 1, "z": "q"}, "id": "a", "name": "f"}, {"arguments": {"k": 2, "z": "s"}, "depends_on": ["a"], "id": "b", "name": "f"}]}
    assert rows[1, 1]["message_json"] == json.dumps(want, sort_keys=True, separators=(",", ":"))


def test_links_and_order(chats):
    rows, _, _ = chats
    place = lambda k: (rows[k]["order_turn"], rows[k]["order_slot"], rows[k]["order_index"])
    assert [rows[1, t]["link"] for t in (2, 3, 4, 5)] == ["linked", "linked", "orphan", "duplicate"]
    assert place((2, 0)) > place((2, 1)) and rows[2, 0]["link"] == "linked"  # a result waits for its call
    assert place((4, 0)) > place((4, 1)) or (rows[4, 0]["order_turn"] == rows[4, 1]["order_turn"] and rows[4, 0]["order_index"] > rows[4, 1]["order_index"])


def test_statuses(chats):
    rows, _, _ = chats
    assert rows[1, 1]["call_status"] == "linked/ok,linked/ok" and rows[1, 1]["n_valid"] == 2
    assert rows[2, 1]["call_status"] == "linked/bad_json" and rows[2, 2]["call_status"] == "duplicate/type:k"
    assert rows[3, 0]["call_status"] == "cycle/missing:k,cycle/extra_argument"
    assert rows[4, 0]["call_status"] == "unanswered/ok" and rows[4, 1]["call_status"] == "unanswered/type:k"


DEEP = {
    "f": {"properties": {"k": {"type": "integer", "minimum": 0, "maximum": 9}, "z": {"enum": ["a", "b"]}, "list": {"type": "array", "items": {"type": "string"}, "minItems": 1}, "in": {"type": "object", "properties": {"n": {"type": "number"}}, "required": ["n"], "additionalProperties": False}}, "required": ["k"], "additionalProperties": False},
    "g": {"properties": {"s": {"type": "string", "minLength": 2, "maxLength": 4}}},
}


def brute_verdict(name, text, schemas):
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return "bad_json"
    if not isinstance(value, dict):
        return "bad_json"
    return "unknown_tool" if name not in schemas else next(iter(brute_faults(value, schemas[name], "")), "ok")


def brute_faults(v, schema, path):
    types = {"string": str, "array": list, "object": dict, "boolean": bool}
    number = isinstance(v, int | float) and not isinstance(v, bool)
    name = path[1:]
    if v is None:
        return
    t = schema.get("type")
    if t and not (isinstance(v, types[t]) if t in types else number and (t == "number" or isinstance(v, int))):
        yield f"type:{name}"
    if "enum" in schema and v not in schema["enum"]:
        yield f"enum:{name}"
    for key, size, says in (("minimum", v if number else None, "range"), ("minLength", len(v) if isinstance(v, str) else None, "length"), ("minItems", len(v) if isinstance(v, list) else None, "length")):
        if size is not None and (size < schema.get(key, size) or size > schema.get(key.replace("min", "max"), size)):
            yield f"{says}:{name}"
    if "items" in schema and isinstance(v, list) and any(next(brute_faults(x, schema["items"], ""), None) for x in v):
        yield f"items:{name}"
    for key, rule in schema.get("properties", {}).items():
        there = isinstance(v, dict) and key in v
        if key in schema.get("required", ()) and not there:
            yield f"missing:{(path + '.' + key)[1:]}"
        if there:
            yield from brute_faults(v[key], rule, f"{path}.{key}")
    if schema.get("additionalProperties", True) is False and isinstance(v, dict) and set(v) - set(schema["properties"]):
        yield f"extra:{name}" if path else "extra_argument"


def dump(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tidy(args):
    try:
        return json.loads(args) if isinstance(args, str) else args
    except ValueError:
        return args


def brute_chat(rows, schemas):
    """(conv_id, turn, order_turn, order_slot, order_index, link, n_calls, n_valid, call_status, message) of each row; turns of a conversation differ."""
    parsed, calls, results = [], {}, {}
    for conv, turn, role, text in rows:
        v = tidy(text) if text and text.lstrip().startswith("{") else None
        v = v if isinstance(v, dict) else None
        own = v.get("tool_calls") if v and role == "assistant" else None
        answers = v.get("tool_call_id") if v and role == "tool" else None
        parsed.append((conv, turn, role, text, v, own if isinstance(own, list) and own else None, answers))
    for conv, turn, role, text, v, own, answers in sorted(parsed, key=lambda r: r[1]):
        for i, c in enumerate(own or ()):
            if c.get("id") is not None:
                calls.setdefault((conv, c["id"]), (turn, i, c))
        if answers is not None:
            results.setdefault((conv, answers), turn)
    place = {}

    def settle(key, trail):
        if key in trail:
            return None
        if key not in place:
            turn, _, c = calls[key]
            found = [settle((key[0], n), trail | {key}) for n in c.get("depends_on") or () if (key[0], n) in calls]
            late = max((f for f in found if f), default=None)
            place[key] = None if None in found else (late[0], late[1] + 1) if late and late[0] >= turn else (turn, 0)
        return place[key]

    for key in calls:  # each by itself, as a circle seen from inside marks more than is behind it
        place.pop(key, None)
        settle(key, frozenset())
    out = []
    for conv, turn, role, text, v, own, answers in parsed:
        body = {k: x for k, x in (("content", text), ("role", role)) if x is not None}
        if own is not None:
            entries = []
            for i, c in enumerate(own):
                key = (conv, c.get("id"))
                first = key in calls and calls[key][:2] == (turn, i)
                at = place.get(key) if first else None
                function = c.get("function") if isinstance(c.get("function"), dict) else {}
                name, args = c.get("name", function.get("name")), c.get("arguments", function.get("arguments"))
                status = "no_id" if c.get("id") is None else "duplicate" if not first else "cycle" if at is None else "linked" if key in results else "unanswered"
                shown = {k: tidy(x) if k == "arguments" else {a: tidy(b) if a == "arguments" else b for a, b in x.items() if b is not None} if k == "function" else x for k, x in c.items() if x is not None}
                entries.append((at[1] if at else 0, i, shown, f"{status}/{brute_verdict(name, args if isinstance(args, str) or args is None else dump(args), schemas)}", at[0] if at else turn))
            entries.sort(key=lambda e: e[:2])
            body = {k: x for k, x in v.items() if x is not None} | {"role": role, "tool_calls": [e[2] for e in entries]}
            out.append((conv, turn, max(e[4] for e in entries), 0, max(e[0] for e in entries), "call", len(entries), sum(e[3].endswith("/ok") for e in entries), ",".join(e[3] for e in entries), dump(body)))
        elif answers is not None:
            key, body = (conv, answers), {k: x for k, x in v.items() if x is not None} | {"role": role}
            known, first = key in calls, results[conv, answers] == turn
            at = (place[key] or (calls[key][0], 0)) if known else None
            linked = known and first
            out.append((conv, turn, max(turn, at[0]) if linked else turn, int(linked), at[1] * 2**32 + calls[key][1] if linked else 0, "orphan" if not known else "linked" if first else "duplicate", 0, 0, None, dump(body)))
        else:
            out.append((conv, turn, turn, 0, 0, "plain", 0, 0, None, dump(body)))
    return sorted(out, key=str)


def random_chats(rng, conversations):
    rows = []
    for conv in range(conversations):
        ids = [f"c{i}" for i in range(rng.randint(1, 9))]
        for turn in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.45:
                made = []
                for _ in range(rng.randint(1, 3)):
                    args = rng.choice([{"k": rng.randint(-1, 11)}, {"k": 1, "z": rng.choice("abc")}, {"k": 2, "list": rng.choice([[], ["x"], ["x", 1]])}, {"k": 3, "in": rng.choice([{}, {"n": 1.5}, {"n": 1, "o": 2}, 4])}, {}, {"k": None}, {"s": "x" * rng.randint(1, 6)}, {"k": 1, "new": [True, {"b": 1, "a": None}]}])
                    args = rng.choice([args, json.dumps(args), json.dumps(args, indent=1), "no json"])
                    name = rng.choice(["f", "g", "h"])
                    call = {"id": rng.choice([*ids, None]), "depends_on": rng.sample(ids, min(len(ids), rng.choice([0, 0, 1, 2]))) or None}
                    call |= {"type": "function", "function": {"name": name, "arguments": args, "strict": None}} if rng.random() < 0.5 else {"name": name, "arguments": args, "note": "é"}
                    made.append(call)
                rows.append((conv, turn, "assistant", json.dumps({"content": rng.choice([None, "go", ""]), "refusal": rng.choice([None, "no"]), "name": "bob", "tool_calls": made}, ensure_ascii=rng.random() < 0.5)))
            elif kind < 0.75:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "none"]), "content": rng.choice(["r", {"b": 1, "a": [2]}, None]), "is_error": rng.choice([True, None])})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant", "tool", "system"]), rng.choice(["hi", '{"tool_calls": []}', '{"tool_calls": 3, "tool_call_id": null}', None, '{"a": "tool_calls"'])))
    return rows


def test_chats_against_brute_force(spark):
    rows = random_chats(random.Random(12), 120)
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), DEEP).collect()
    found = sorted(((r["conv_id"], r["turn"], r["order_turn"], r["order_slot"], r["order_index"], r["link"], r["n_calls"], r["n_valid"], r["call_status"], r["message_json"]) for r in got), key=str)
    want = brute_chat(rows, DEEP)
    assert [f[:9] for f in found] == [w[:9] for w in want]
    assert [f[9] for f in found] == [w[9] for w in want]


def test_a_long_chain_and_a_large_circle(spark):
    chain = [(1, 0, "assistant", calls(*({"id": f"a{i}", "name": "f", "arguments": {"k": i}, "depends_on": [f"a{i + 1}"]} for i in range(6))))]
    circle = [(2, i, "assistant", calls({"id": f"b{i}", "name": "f", "arguments": {"k": i}, "depends_on": [f"b{(i + 1) % 300}"]})) for i in range(300)]
    got = {(r["conv_id"], r["turn"]): r for r in format_chats(spark.createDataFrame(chain + circle, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert [c["arguments"]["k"] for c in json.loads(got[1, 0]["message_json"])["tool_calls"]] == [5, 4, 3, 2, 1, 0]
    assert all(got[2, i]["call_status"] == "cycle/ok" and got[2, i]["order_turn"] == i for i in range(300))
