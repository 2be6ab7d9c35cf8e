import datetime
import random

from civicspark.llm import transcripts as X


def test_labels():
    for s, n in {"SPEAKER_01": 1, " speaker 01 ": 1, "spk 1": 1, "Spkr. 1": 1, "S4": 4, "Speaker-0": 0, "SPK03": 3, "[SPK03]": 3}.items():
        assert X.label_number(s) == n
    for s in ("Jane Doe", "Speaker", "S", "", None, "Speaker 1 (2024-01-01)"):
        assert X.label_number(s) is None


def test_clean_segments():
    for text, want in {
        "[00:01:53] Our office uh-huh, moved the um... gutter": ("Our office moved the gutter", None),
        ">> SPEAKER 02: erm, Parents tested it. (01:08)": ("Parents tested it.", 2),
        "(S6) The mural near you know, us": ("The mural near us", 6),
        "SPEAKER_3 - Second.": ("Second.", 3),
        "00:00:15 --> 00:00:20 Speaker 1: Okay.": ("Okay.", 1),
        "do you know that I agree (as in Section 2)?": ("do you know that I agree (as in Section 2)?", None),
        "the umbrella and the ahead thing": ("the umbrella and the ahead thing", None),
        "a speaker 2 meters away": ("a speaker 2 meters away", None),
    }.items():
        clean, n, _, spoken = X.clean_segment(text)
        assert (clean, n) == want and spoken, text
    for text in ("[MUSIC]", "♪ ♪", "((gavel))", "{background noise}", "*laughter*", "<noise>", "mm-hmm? er,", "[00:00:01] (inaudible 00:04)", "", None, " ... ", "00:00:15 --> 00:00:20 [MUSIC]"):
        assert not X.clean_segment(text)[3], text


T0 = datetime.datetime(2024, 1, 1)
SEG = "segment_id bigint, meeting_id string, start_s double, end_s double, text string, speaker string, received_at timestamp, turn int"


def table(spark, rows):
    return spark.createDataFrame([(*r, T0, 9) if len(r) == 6 else (*r, 9) for r in rows], SEG)


def maps(spark, rows):
    return spark.createDataFrame(rows, "meeting_id string, speaker_map map<string,string>")


def test_turns(spark):
    rows = [
        (1, "m", 0.0, 1.0, "a", "SPEAKER_01"), (2, "m", 1.5, 2.0, "b", "spk 1"), (3, "m", 2.1, 2.2, "um", "S2"), (4, "m", 2.5, 3.0, "c", "Jane  DOE "), (5, "m", 4.0, 5.0, "d", "S1"), (6, "m", 5.5, 6.0, "[SPK02] e", None),
        (7, "m", 6.1, 6.5, "f", ""), (8, "m", 6.6, 7.0, "g", "unknown"), (9, "m", 7.1, None, "Jane Doe: h", "unk"), (10, "m", None, 1.0, "i", "S1"), (11, None, 0.0, 1.0, "j", "S1"), (2, "m", 1.5, 2.0, "b", "spk 1"),
        (12, "m", 7.3, 7.5, "k", "Speaker 1 (2024-01-01)"), (13, "m", 7.6, 7.7, "l", "SPEAKER_05"),
    ]
    m = maps(spark, [("m", {"SPEAKER_01": "Jane Doe", "SPEAKER_05": "Speaker 1 (2024-01-01)"}), ("m", None)])
    got = [(r.first_segment_id, r.last_segment_id, r.speaker, r.text) for r in X.turns(table(spark, rows), m).orderBy("start_s").collect()]
    assert got == [(1, 4, "speaker 1", "a b c"), (5, 5, "speaker 1", "d"), (6, 6, "speaker 2", "e"), (7, 8, "unknown", "f g"), (9, 9, "speaker 1", "h"), (12, 13, "speaker 5", "k l")]
    assert X.turns(table(spark, []), m).count() == 0 and X.turns(table(spark, rows), maps(spark, [])).count() > 0


def test_slices_change_nothing(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for k in range(400):
        d = rng.choice([0.5, 2.0, 30.0])
        rows.append((k, "m", round(t, 3), round(t + d, 3), "word", f"S{rng.randrange(2)}"))
        t += d + rng.choice([0.1, 0.999, 1.0, 1.2, 90.0 if rng.random() < 0.1 else 0.2])
    want, prev = [], None
    for r in rows:
        if prev is None or prev[5] != r[5] or round(r[2] - prev[3], 6) >= 1.0:
            want.append([r[0], r[0]])
        want[-1][1] = r[0]
        prev = r
    rng.shuffle(rows)
    for s in (7, 60, 100_000):
        got = X.turns(table(spark, rows), maps(spark, []), slice_s=s).orderBy("start_s").collect()
        assert [[r.first_segment_id, r.last_segment_id] for r in got] == want
