import random

from helpers import documents, words

from changeseries.llm import quality
from changeseries.llm.quality import STOP_WORDS, Threshold


def brute(text):
    text = text or ""
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    stops = {s.encode() for s in STOP_WORDS}
    return {
        "n_words": len(found),
        "word_chars": sum(len(w.decode()) for w in found),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in stops for w in found),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
        "n_exclamations": text.count("!"),
    }


def texts():
    rng = random.Random(4)
    pieces = ["the", "of", "Über", "a", "#", "x|y", "wow!", "\n", "\n\n", "\t", "😀", "\u00a0", "...", "b"]
    out = [" ".join(rng.choices(pieces, k=rng.choice([0, 3, 10, 30, 90]))) for _ in range(60)]
    return out + ["a b c d e f g h " * 4, "x " * 40, "", None, " \n ", "same line\nsame line\nsame  line", "word " * 20_000, "1 2 3 4 5 6 7 8"]


def test_measures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.asDict() for r in quality.judge(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for identity, text in rows:
        want = brute(text) if len(text or "") < 50_000 else None
        if want:
            assert {k: got[identity][k] for k in want} == want
            assert got[identity]["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert got[identity]["kept"] == (not got[identity]["base_failed"] and not got[identity]["failed"])
    assert got[len(rows) - 2]["n_repeat_words"] == 20_000


def test_table_is_the_only_source_of_rules(spark):
    frame = documents(spark, [(1, "one two three ###"), (None, None), (1, "one two three ###")])
    table = (Threshold("short", "n_words", "one", 10), Threshold("marks", "n_symbols", "n_words", high=0.5, from_words=1))
    rows = quality.judge(frame, thresholds=table).collect()
    assert sorted((str(r.doc_id), r.failed) for r in rows) == [("1", ["short", "marks"])] * 2 + [("None", ["short"])]
    assert {r.kept for r in quality.judge(frame, thresholds=()).collect()} == {False}
    assert quality.judge(documents(spark, [])).collect() == []


def test_no_user_function_and_no_shuffle(spark, capsys):
    quality.judge(documents(spark, [(1, "a")]).coalesce(1)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1


POLISH = (
    "Rano poszliśmy przez stary las aż nad brzeg jeziora, gdzie rybacy suszyli sieci i naprawiali łodzie. Woda była spokojna, "
    "niebo szare, a wiatr przynosił zapach mokrych liści. Dziadek opowiadał nam dawne historie z czasów swojej młodości, kiedy zimą całe "
    "miasteczko jeździło saniami po lodzie. Potem usiedliśmy przy ognisku, piekliśmy ziemniaki oraz kiełbasy, słuchając śpiewu ptaków aż do zmierzchu, "
    "kiedy pierwsze gwiazdy pojawiły się wysoko nad spokojną taflą wody."
)
ITALIAN = (
    "Questa mattina siamo andati presto verso il vecchio mercato della città, dove contadini gentili vendevano frutta fresca, formaggi stagionati "
    "ed enormi pagnotte ancora calde. Mia nonna sceglieva ogni pomodoro guardandolo bene contro luce, mentre noi bambini correvamo fra banchi colorati "
    "cercando dolci nascosti dentro grandi vasi trasparenti. Dopo pranzo abbiamo camminato lungo fiume osservando barche lente, pescatori pazienti, "
    "ragazzi rumorosi sotto alberi altissimi, finché tramonto dorato coprì tutte quelle colline lontane."
)


def test_clean_texts_of_other_languages_and_lengths_are_kept(spark):
    long = " ".join(f"the{i} of word{i % 977}" for i in range(400_000))
    rows = [(1, POLISH, "pl"), (2, ITALIAN, "it"), (3, POLISH, "en"), (4, POLISH, None), (5, long, "en")]
    frame = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, language long")
    kept = {r.doc_id: (r.kept, r.failed) for r in quality.judge(frame, language_column="lang").collect()}
    assert kept == {1: (True, []), 2: (True, []), 3: (False, ["stop_words"]), 4: (False, ["stop_words"]), 5: (True, [])}
