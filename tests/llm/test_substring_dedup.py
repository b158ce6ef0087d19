import random
import re

import pytest

from skeinflow.llm import substring_dedup as sd


def brute(rows, min_words):
    first, first_line, found = {}, {}, {}
    for doc, text in sorted(set((d, t or "") for d, t in rows), key=lambda r: r[0]):
        units = []
        for m in re.finditer(r"(?:[^\n.!?]|[.!?](?![ \t\n\x0b\x0c\r]))*(?:[.!?]|\n|\Z)[ \t\x0b\x0c\r\n]?", text):
            body = m.group().strip(" \t\n\x0b\x0c\r")
            w = tuple(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda x: x.group().lower(), body)))
            if w:
                start = m.start() + m.group().index(body)
                units.append((w, start, start + len(body), first.setdefault(w, (doc, start)) != (doc, start)))
        runs, before = [], False
        for w, a, b, repeated in units:
            if repeated and before:
                runs[-1] = (runs[-1][0], b, runs[-1][2] + len(w))
            elif repeated:
                runs.append((a, b, len(w)))
            before = repeated
        gone = [(a, b) for a, b, n in runs if n >= (12 if min_words is None else min_words)]
        lines = []
        for m in re.finditer(r"[^\n]+", text):
            w = tuple(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda x: x.group().lower(), m.group())))
            if w and first_line.setdefault(w, (doc, m.start())) != (doc, m.start()):
                lines.append(m.span())
        if min_words is None:
            # repeated lines outside the long spans, joined where no other sentence is between them
            inside = lambda u, spans: any(a <= u[1] and u[2] <= b for a, b in spans)
            before = False
            for u in units:
                now = inside(u, lines) and not inside(u, gone)
                if now and before:
                    gone[-1] = (gone[-1][0], u[2])
                elif now:
                    gone.append((u[1], u[2]))
                before = now
        found[doc] = sorted(gone)
    return found


def corpus():
    rng = random.Random(2)
    words = ["Alpha", "beta", "gamma", "délta", "x1", "e.g", "世界"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 20))) + rng.choice([".", "!", "", "?"]) for _ in range(60)]
    lines += [". ".join(rng.choice(words) for _ in range(rng.randint(2, 4))) for _ in range(20)]
    texts = []
    for _ in range(150):
        parts = [rng.choice(lines) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 15))) + "." for _ in range(rng.randint(1, 8))]
        texts.append(rng.choice(["", "  "]) + "".join(p + rng.choice([" ", "\n", "\n\n", "  ", "\t"]) for p in parts))
    return list(enumerate([*texts, None, "", " \n", "...", lines[0] * 50, lines[3].upper()]))


@pytest.mark.parametrize(("min_words", "chunk"), [(1, 1 << 18), (12, 100), (None, 1 << 18), (None, 100)])
def test_matches_brute_force(spark, monkeypatch, min_words, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3)
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], r.text) for r in sd.substring_dedup(df, min_words=min_words).collect()}
    want = brute(rows, min_words)
    assert {d: s for d, (s, _) in got.items()} == want
    for doc, text in rows:
        kept = text or ""
        for a, b in reversed(want[doc]):
            kept = kept[:a] + " " + kept[b:]
        assert got[doc][1].split() == kept.split()
        if not want[doc]:
            assert got[doc][1] == (text or "")


def test_passage_inside_a_longer_line(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(" ".join(word() for _ in range(10)).capitalize() + "." for _ in range(6))
    host = lambda: " ".join(word() for _ in range(30))
    rows = [(1, f"{host()} {passage} {host()}"), (2, f"{host()}\n{passage}\n{host()}"), (3, host())]
    got = {r.doc_id: r for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].spans and not got[3].spans
    (span,) = got[2].spans
    assert len(rows[1][1][span.start : span.end].split()) >= 50


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.substring_dedup(none).collect() == []
    line = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(5, line), (5, line), (None, line + "!"), (7, line), (7, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in sd.substring_dedup(df).collect()), key=str)
    assert got == [(5, ""), (5, ""), (7, ""), (7, "b"), (None, line + "!")]


def test_short_repeated_lines_go_and_short_sentences_in_a_line_stay(spark):
    rows = [
        (1, "Licensed to all.\nYes. It is new here.\nShared. Twice."),
        (2, "Licensed to all.\nAnother text. Yes. Goes on.\n\nShared. Twice."),
        (3, "Begins here. Yes.\nLicensed to all.\r\nYes. Ends here."),
        (4, "Licensed to all."),
    ]
    got = {r.doc_id: r.text for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Another text. Yes. Goes on.", 3: "Begins here. Yes.\nYes. Ends here.", 4: ""}


def test_a_line_of_sentences_from_elsewhere_stays(spark):
    rows = [(1, "Yes we can."), (2, "No you can not."), (3, "Yes we can. No you can not.\nother unique words"), (4, "No you can not. Yes we can."), (5, "yes we can; no you can not\nno you can not, yes we can!")]
    got = {r.doc_id: r.text for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: rows[3][1], 5: rows[4][1]}
    rows = [(1, "Yes. No."), (2, "Oh.\nYes. No.\n no! YES\nyes; no"), (3, "Yes. No.\nYes. No.\nNo. Yes.")]
    got = {r.doc_id: r.text for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Yes. No.", 2: "Oh.\nno! YES\nyes; no", 3: ""}


@pytest.mark.parametrize(("chunk", "parts"), [(1 << 18, 1), (1, 4)])
def test_identical_rows_keep_their_text(spark, monkeypatch, chunk, parts):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, line), (5, line), (6, f"own\n{line}\n{line} x"), (6, f"own\n{line}\n{line} x"), (8, f"a\na\n{line} x"), (8, f"a\na\n{line} x"), (None, "b"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(((r.doc_id, r.text) for r in sd.substring_dedup(df).collect()), key=str)
    assert got == [(5, line)] * 2 + [(6, f"own\n{line} x")] * 2 + [(8, "a")] * 2 + [(None, "b")] * 2


def test_cutting_takes_linear_time():
    text = "keep me. drop it! " * 100_000
    spans = [{"start": i * 18 + 9, "end": i * 18 + 17} for i in range(100_000)]
    assert sd._cut(text, spans) == "keep me. " * 99_999 + "keep me."
    assert sd._cut("a\nb\nc", [{"start": 2, "end": 3}]) == "a\nc"
    assert sd._cut(" a b ", [{"start": 1, "end": 2}]) == "b "
    assert sd._cut("x", []) == "x" and sd._cut("x", [{"start": 0, "end": 1}]) == ""
