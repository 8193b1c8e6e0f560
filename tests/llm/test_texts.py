"""Pieces, counts, media, chats and decontamination on small cases, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from scriptorium.llm import chat, decontamination, media, piece_dropout, token_counts

ODD = [None, "", " ", "  ", "\n", "a ▁b", "x\x00y\t", "日本語 テスト", "ﬁ é  　", "a" * 300 + " " * 40 + "b", "😀" * 60, "\n\n  \n ", "Hello world. " * 200]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")


def test_pieces_without_dropout_are_those_of_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = piece_dropout.Encoder(piece_dropout.load_vocabulary(), 0.0)
    for t in ODD:
        if t and "▁" not in t:
            assert np.frombuffer(encoder.encode(t), "<u2").tolist() == sp.encode(t)


def test_pieces_round_trip_and_vary(spark):
    rows = piece_dropout.decode(piece_dropout.encode(frame(spark, ODD))).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == {i: t or "" for i, t in enumerate(ODD)}
    vocabulary = piece_dropout.load_vocabulary()
    seeds = {piece_dropout.Encoder(vocabulary, 0.3, s).encode("international considerations") for s in range(8)}
    assert len(seeds) > 3
    assert piece_dropout.Encoder(vocabulary, 0.3, 1).encode(ODD[-1]) == piece_dropout.Encoder(vocabulary, 0.3, 1).encode(ODD[-1])
    assert piece_dropout.encode(frame(spark, ODD).limit(0)).count() == 0


def test_a_word_is_segmented_anew_where_it_occurs_again():
    """At 20,000 places a word has hundreds of segmentations, and each is what its own draws give."""
    e = piece_dropout.Encoder(piece_dropout.load_vocabulary(), 0.3)
    decoder = piece_dropout.Decoder(e.v.pieces)
    texts = ["internationalization " * 1000 + str(i) for i in range(20)]
    packed = e.encode_all(texts)
    assert [decoder.decode(p).decode() for p in packed] == texts
    keys = [int(k) for t in texts for k in e.keys(t, 1000)]
    own = [e.packed(" internationalization", k) for k in keys]
    assert len(set(own)) > 200
    assert packed[3].startswith(b"".join(own[3000:4000]))


def test_segmenting_together_equals_one_by_one():
    """Words that share draws' outcomes, odd and long ones among them, get what their keys alone give."""
    rng = random.Random(6)
    e = piece_dropout.Encoder(piece_dropout.load_vocabulary())
    words = ["the", "of", "considerations", "straße", "日本語", "😀", "a" * 60, "x" * 47, "  ", "\n", "und", "▁", "Kai's"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(12)] + ["", "one"]
    for text, packed in zip(texts, e.encode_all(texts), strict=True):
        own = piece_dropout.WORDS.findall(" " + text) if text else []
        assert packed == b"".join(e.packed(w, int(k)) for w, k in zip(own, e.keys(text, len(own)), strict=True))


def test_models_with_pieces_over_words_are_refused(monkeypatch):
    class Odd:
        def __init__(self, model_file):
            self.pieces = ["<unk>", "a", "a▁b"]

        get_piece_size = lambda self: 3
        id_to_piece = lambda self, i: self.pieces[i]
        is_byte = is_control = is_unused = lambda self, i: False
        is_unknown = lambda self, i: i == 0
        get_score = lambda self, i: -float(i)

    monkeypatch.setattr(piece_dropout.sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="several words"):
        piece_dropout.load_vocabulary("odd.model")


def test_the_query_shows_that_nothing_is_lost(spark, tmp_path):
    frame(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    rows = piece_dropout.op2_merge_dropout_pieces(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(ODD)}
    assert all((r["text_crc32"], r["text_bytes"]) == (r["decoded_crc32"], r["decoded_bytes"]) for r in rows)


def test_three_ways_of_segmenting_agree():
    e = piece_dropout.Encoder(piece_dropout.load_vocabulary(), 0.2)
    words = {f" w{'ordering'[: i % 8]}{i * 7919}tion" for i in range(300)} | {" " + "therefore" * 5, "x" * 48, " été"}
    words, keys = sorted(words, key=len), e.keys("seed", len(words))
    made = e._many(words, keys)
    for w, k, packed in zip(words, keys.tolist(), made, strict=True):
        assert e._short(w, k) == e._long(w, k)
        assert packed == e.packed(w, k)


def test_token_trees_follow_edits(spark):
    encoding = token_counts.load_encoding()
    counter, r = token_counts.Counter(encoding), random.Random(5)
    for t in ODD:
        text = t or ""
        tree = token_counts.Tree.of(text, counter)
        for _ in range(12):
            assert tree.total == len(encoding.encode_ordinary(text))
            at, gone = r.randrange(len(text) + 3), r.choice([0, 1, 5, 90])
            new = r.choice([*token_counts.INSERTED, "  ", "\t", "\x1c", " a" * 200])
            tree.edit(at, gone, new, counter)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text == text


def test_edits_by_document(spark):
    trees = token_counts.build_trees(frame(spark, ["one two three", None, "left alone"]))
    edits = [(0, 1, 3, 4, " 2"), (0, 0, 0, 0, "zero "), (1, 0, 9, 9, "new"), (7, 0, 0, 0, "lost"), (0, 2, None, None, None)]
    got = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.with_edits(trees, spark.createDataFrame(edits, "doc_id long, seq int, at long, removed long, inserted string"))).collect()}
    assert {i: r["text"] for i, r in got.items()} == {0: "zer 2e two three", 1: "new", 2: "left alone"} or got[0]["text"] == "zer 2ne two three"
    encoding = token_counts.load_encoding()
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(r["text"])) for r in got.values())
    assert got[2]["encoded_chars"] == 0


def test_counts_of_the_query_and_of_empty_tables(spark, tmp_path):
    docs = frame(spark, [*ODD, ODD[-1]])
    docs.unionAll(docs.where("doc_id = 5")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = token_counts.op3_edit_aware_token_counts(spark, str(tmp_path)).collect()
    encoding = token_counts.load_encoding()
    texts = dict(enumerate([*ODD, ODD[-1]]))
    assert len(rows) == len(texts) + 1
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(texts[r["doc_id"]] or "")) for r in rows)
    again = [tuple(r) for r in rows if r["doc_id"] == 5]
    assert len(again) == 2 and again[0] == again[1]
    edits = spark.createDataFrame([], "doc_id long, seq int, at long, removed long, inserted string")
    none = token_counts.build_trees(frame(spark, ["a"]).limit(0))
    assert token_counts.apply_edits(token_counts.with_edits(none, edits)).count() == 0


def test_contract_columns_of_streams(spark, tmp_path):
    frame(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    for r in media.op6_transport_streams(spark, str(tmp_path)).collect():
        raw = (ODD[r["doc_id"]] or "").encode()
        payload = media.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), hashlib.sha256(media.mux(payload)).hexdigest())


def test_contract_columns_of_decontamination(spark, tmp_path):
    items, _ = bench_items()
    frame(spark, [None, "clean", items[2][1]]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = decontamination.op4_bm25_decontamination(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in rows] == [(2, 2, 1.0, 1.0)] and abs(rows[0]["score"] - 1) < 1e-6


@pytest.mark.parametrize("n", [*range(0, 400, 7), 4591, 4592, 4608, 4609, 20000])
def test_streams_round_trip(n):
    text = bytes(i * i % 251 for i in range(n))
    found = media.demux(media.mux(media.padded(text)))
    assert found["payload"] == media.padded(text) and len(found["payload"]) % 576 == 0
    assert (found["gaps"], found["broken"]) == (0, 0) and found["points"][0][1] == media.FIRST_PTS
    assert found["times"] == sorted(found["times"])


def test_streams_report_damage():
    stream = media.mux(media.padded(b"x" * 30000))
    assert media.demux(stream[: 188 * 9] + stream[188 * 10 :])["gaps"] == 1
    broken = bytearray(stream)
    broken[188 * 3] = 0
    assert media.demux(bytes(broken))["broken"] >= 1
    assert media.demux(b"")["payload"] == b"" and media.demux(b"junk" * 100)["payload"] == b""


def test_streams_with_copies_junk_and_lost_packets():
    payload = media.padded(bytes(i % 256 for i in range(30000)))
    stream = media.mux(payload)
    at = lambda n: 188 * n
    twice = media.demux(stream[: at(10)] + stream[at(9) :])
    assert twice["payload"] == payload and (twice["gaps"], twice["twice"], twice["odd_units"]) == (0, 1, [])
    junk = media.demux(b"\x47 junk" + stream)
    assert junk["payload"] == payload and junk["broken"] == 1 and junk["gaps"] == 0
    inside = media.demux(stream[: at(20)] + b"lost bytes" + stream[at(20) :])
    assert inside["payload"] == payload and inside["gaps"] == 0
    lost = media.demux(stream[: at(9)] + stream[at(10) :])
    assert (lost["gaps"], lost["odd_units"]) == (1, [0]) and len(lost["payload"]) == len(payload) - 184
    jump = bytearray(stream)
    for n in range(at(40), len(jump), 188):
        if jump[n + 1 : n + 3] == bytes([media.ES_PID >> 8 | jump[n + 1] & 0x40, media.ES_PID & 255]):
            jump[n + 3] = jump[n + 3] & 0xF0 | (jump[n + 3] + 5) & 15
    assert media.demux(bytes(jump))["gaps"] == 1 and media.demux(bytes(jump))["payload"] == payload


def test_media_of_empty_tables_and_repeated_rows(spark):
    docs = frame(spark, ["a", "a", None])
    rows = media.read(media.store(docs.unionAll(docs))).collect()
    assert len(rows) == 6 and len({r["media_sha256"] for r in rows}) == 2
    assert media.read(media.store(docs.limit(0))).count() == 0


def test_media_columns(spark):
    got = {r["doc_id"]: r for r in media.read(media.store(frame(spark, [*ODD, "é" * 3000]))).collect()}
    for i, t in enumerate([*ODD, "é" * 3000]):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-32:])


TREE = "tree_id long, node_id long, parent_id long, role string, text string, score double, turns string"


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "root <|im_end|> <\\|x|>", 1.0), (1, 2, 1, "assistant", "left", 5.0), (1, 3, 1, "assistant", None, 2.0),
        (1, 4, 2, "user", "<|", None), (1, 5, 4, "assistant", "<\\\\|\n|>", 1.0), (1, 6, 99, "a%0A\nb", "orphan", 0.5), (2, 1, None, None, "alone", None),
    ]
    nodes = spark.createDataFrame([(*r, "clash") for r in rows], TREE)
    back = {(r["tree_id"], r["leaf_id"]): r for r in chat.read_back(chat.format_paths(nodes, chat.enumerate_paths(nodes))).collect()}
    texts = {(t, n): (role or "", text or "") for t, n, _, role, text, _ in rows}
    paths = {(1, 5): [1, 2, 4, 5], (1, 3): [1, 3], (1, 6): [6], (2, 1): [1]}
    assert set(back) == set(paths)
    for (tree, leaf), nodes_ in paths.items():
        expected = [texts[tree, n] for n in nodes_]
        assert [tuple(t) for t in back[tree, leaf]["turns"]] == expected
        assert back[tree, leaf]["loss_text"] == "".join(x for r, x in expected if r == "assistant")
        assert back[tree, leaf]["formatted"].count("<|im_start|>") == len(nodes_)
    assert {k: r["branch_rank"] for k, r in back.items()} == {(1, 5): 1, (1, 3): 2, (1, 6): 3, (2, 1): 1}
    assert chat.format_paths(nodes.limit(0), chat.enumerate_paths(nodes.limit(0))).count() == 0


def test_the_best_branches_are_chosen(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 3.0), (1, 3, 1, 5.0), (1, 4, 1, 3.0), (1, 5, 2, None), (2, 1, None, None)]
    nodes = spark.createDataFrame([(t, n, p, "user", f"t{n}", s, "") for t, n, p, s in rows], TREE)
    paths = chat.enumerate_paths(nodes)
    chosen = lambda best: {(r["tree_id"], r["leaf_id"], r["branch_rank"], r["path_score"]) for r in chat.format_paths(nodes, paths, best).collect()}
    assert chosen(None) == {(1, 3, 1, 5.0), (1, 4, 2, 3.0), (1, 5, 3, 3.0), (2, 1, 1, 0.0)}
    assert chosen(2) == {(1, 3, 1, 5.0), (1, 4, 2, 3.0), (2, 1, 1, 0.0)} and chosen(1) == {(1, 3, 1, 5.0), (2, 1, 1, 0.0)}


def test_conversations_without_id_and_equal_turns(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "assistant", None), (5, None, None, "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op7_reply_trees(spark, str(tmp_path)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert set(got) == {None, 5, -1} and got[5]["n_turns"] == 4
    assert got[None]["turns_sha256"] == digest([("user", "a"), ("assistant", "b")])
    assert got[5]["turns_sha256"] == digest([("", "y"), ("assistant", ""), ("user", "x"), ("user", "x")]) and got[5]["loss_chars"] == 0
    assert got[-1]["loss_sha256"] == hashlib.sha256(chat.CONTROL_TEXT.encode()).hexdigest()


def test_rings_of_replies_are_refused(spark):
    ring = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0, ""), (1, 2, 1, "user", "b", 0.0, "")], TREE)
    with pytest.raises(ValueError, match="ring"):
        chat.enumerate_paths(ring)


def bench_items():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    return [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(30)], word


def test_retrieval_loses_nothing_above_the_threshold():
    items, word = bench_items()
    index = decontamination.build_index([*items, (99, None or ""), (98, items[0][1])])
    r = random.Random(9)
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.randrange(0, 400))]
        part = items[i % 30][1].split()
        w[len(w) // 2 : len(w) // 2] = part[: r.randrange(len(part) + 1)]
        docs.append(" ".join(w).encode())
    texts = {98: items[0][1], **dict(items)}
    bags = {i: Counter(decontamination.words_of(t.encode())) for i, t in texts.items()}
    df, mean = Counter(w for b in bags.values() for w in b), sum(map(Counter.total, bags.values())) / len(bags)

    def impact(bag, w):
        idf = np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
        return idf * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * bag.total() / mean))

    for threshold in (0.1, 0.3, 0.5):
        got = {(d, i) for d, i, *_ in decontamination.find(index, docs, threshold, 0.0)}
        expected = set()
        for d, doc in enumerate(docs):
            words = decontamination.words_of(doc)
            for s in range(0, max(1, len(words) - index.stride), index.stride):
                own = set(words[s : s + 2 * index.stride])
                for i, bag in bags.items():
                    if sum(impact(bag, w) for w in bag if w in own) >= threshold * sum(impact(bag, w) for w in bag) - 1e-9:
                        expected.add((d, i))
        assert got == expected


def test_scores_do_not_depend_on_the_slices(spark, monkeypatch):
    items, word = bench_items()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [None, "clean words", *(f"{word()} {t} {word()}" for _, t in items[::3])])
    found = lambda: sorted(tuple(r) for r in decontamination.contaminated(docs, benchmark).collect())
    flags = lambda: sorted((r["doc_id"], r["held"]) for r in decontamination.with_flag(docs, benchmark, "held").collect())
    whole, flagged = found(), flags()
    monkeypatch.setattr(decontamination, "SLICE_WORDS", 250)
    assert len(whole) == 10 and sum(x for _, x in flagged) == 10
    assert [r[:2] for r in found()] == [r[:2] for r in whole] and np.allclose([r[2:] for r in found()], [r[2:] for r in whole])
    assert flags() == flagged


def test_copies_with_one_word_changed_are_found_at_each_place():
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    lengths = [(q, a) for q in (9, 16, 30) for a in (1, 2, 3, 4, 5, 7, 9, 13, 14, 20)] + [(1, 12), (3, 12), (12, 0), (6, 0)]
    items = [(n, f"{some(q)}{'?.'[n % 2]} {some(a)}".strip() + ".") for n, (q, a) in enumerate(x for x in lengths for _ in range(2))]
    index = decontamination.build_index(items)
    for i, text in items:
        w = text.split()
        docs = []
        for at in range(len(w)):
            mark = re.sub(r"\w", "", w[at])
            docs.append(" ".join([some(70), *w[:at], "zzz" + mark, *w[at + 1 :], some(70)]).encode())
        found = {d for d, n, *_ in decontamination.find(index, docs) if n == i}
        n_question, n_answer = lengths[i // 2]
        alone = {0} if n_question == 1 else {len(w) - 1} if n_answer == 1 else set()  # a part of one word that is gone
        assert found == set(range(len(w))) - alone, text


def test_a_question_without_its_answer_nearby_is_not_held():
    items = [(1, "aa bb cc dd ee ff gg hh ii jj kk ll mm nn? pp qq rr."), (2, "ab ac ad ae af ag ah ai aj ak al am an ao. bp bq br bs.")]
    index = decontamination.build_index(items)
    docs = [f"{items[0][1].split('?')[0]} {'x ' * 60} pp y qq".encode(), f"{items[1][1].split('.')[0]} no such words here".encode(), b"pp qq rr"]
    assert decontamination.find(index, docs) == []


def test_answers_of_one_word_are_asked_for_near_the_question():
    question = "which of the seven old harbours of the northern land was the first to have a lighthouse"
    items = [(1, f"{question}? Paris"), (2, f"Yes. {question.replace('seven', 'eleven')} of stone")]
    index = decontamination.build_index(items)
    far = "x " * 200
    docs = [f"{far}{question}? Paris {far}", f"{far}{question}? London {far}", f"Paris {far}{question}? {far}", f"{far}Paris, {question}.{far}", "Paris"]
    assert {(d, i) for d, i, *_ in decontamination.find(index, [t.encode() for t in docs]) if i == 1} == {(0, 1), (3, 1)}


def test_contaminated_documents(spark):
    items, _ = bench_items()
    benchmark = spark.createDataFrame([*items, (50, None), (51, " "), (None, "x y z")], "item_id long, text string")
    upper = re.sub(r"\W+", " -- ", items[4][1]).upper()
    docs = frame(spark, [None, "", "clean words only here", f"before {items[3][1]} after", upper, items[3][1].split(".")[0]])
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == {(3, 3), (4, 4)}
    flagged = decontamination.with_flag(docs, benchmark, "held")
    assert {r["doc_id"] for r in flagged.where("held").collect()} == {3, 4} and flagged.columns == [*docs.columns, "held"]
    assert decontamination.with_flag(docs, benchmark.limit(0), "held").where("held").count() == 0
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == 0
