"""Operators p7 and p9: other encoders, hostile texts, and pages made for the purpose."""

import base64
import random

import pytest
from hypothesis import given, settings, strategies as st

from voxelmill.llm import bpe, stuffing
from voxelmill.llm.queries import p7_ids
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe._read(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("judge", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=300) | st.text(alphabet="ab '\n1<|endoftext|>é漢字", max_size=400))
def test_ids_are_those_of_another_encoder(encoder, judge, text):
    assert encoder.encode([text])[0] == judge(text)


@pytest.mark.parametrize("unit,n", [("a", 5000), ("ab", 3000), ("漢", 2000), ("_", 1500), (" ", 4000), ("x1", 700), ("the", 9000)])
def test_long_words(encoder, judge, unit, n):
    text = unit * n
    assert encoder.encode([text])[0] == judge(text)


def test_random_long_word_takes_the_tree_in_lists(encoder, judge):
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshr") for _ in range(30_000))
    assert encoder.encode([text])[0] == judge(text)


def test_store_is_emptied(encoder, monkeypatch, judge):
    monkeypatch.setattr(bpe, "KEPT", 3)
    for text in ("one two three four five six", "seven eight", "one two"):
        assert encoder.encode([text])[0] == judge(text)


def test_corpus(spark, judge):
    rows = [(1, "Top pocket"), (2, None), (3, ""), (4, "  \n\t "), (5, "<|endoftext|>"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc long, body string").selectExpr("doc", "body", "'x' AS ids", "1 AS tokens")
    got = [(r["doc"], list(r["ids"])) for r in bpe.encode_corpus(df, "doc", "body").collect()]
    assert sorted(got, key=str) == sorted([(d, judge(t) if t else []) for d, t in rows], key=str)
    counted = {(r["doc"], r["tokens"]) for r in bpe.encode_corpus(df, "doc", "body", count=True).collect()}
    assert counted == {(d, len(i)) for d, i in got}
    assert bpe.encode_corpus(df.limit(0), "doc", "body").count() == 0


def test_whole_table_round_trip(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    decode = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).decode
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = p7_ids(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


# ---------------------------------------------------------------- p9

PROSE = (
    "We measured the affinity of the compound in a second assay, and it was lower than before. "
    "The loop closes over the ligand when the calcium ion is bound, which we had not seen in the first run. "
    "Nobody has explained why the label file lists neither of the two residues. "
)


def ordinary(n, seed=6):
    """Pages of sentences over a vocabulary with Zipf's law: what the norms come from."""
    rng = random.Random(seed)
    parts = "b c d f g h l m n p r s t v st tr ch br".split(), "a e i o u ea ou".split(), ["", "n", "r", "s", "l", "d"]
    words = ["".join(rng.choice(p) for _ in range(max(1, min(4, k.bit_length() // 3))) for p in parts) for k in range(4000)]
    weights = [1 / (k + 2) for k in range(4000)]
    say = lambda: " ".join(rng.choices(words, weights, k=rng.randrange(8, 20))).capitalize() + "."
    return [" ".join(say() for _ in range(rng.randrange(3, 30))) for _ in range(n)]


def pages():
    rng = random.Random(2)
    words = ["gene synthesis", "cheap reagents", "assay kit", "pocket finder"]
    names = ["Corven", "Fali", "Quagan", "Dekxo", "Tadek", "Murin", "Zelta", "Brogan"]
    goods = ["kit", "resin", "buffer", "plate", "vial", "column"]
    pick = lambda x: rng.choice(x)
    spam = {
        "list": ", ".join(rng.choice([str.upper, str.title, str])(pick(words)) for _ in range(80)),
        "lines": "\n".join(pick(words) for _ in range(60)),
        "templates": " ".join(pick(["Best {0} {1} {0}.", "Buy {0} online {1} now!", "Looking for {0}? {0} {1} {0} here.", "{0} and {1} and {0} for {1}."]).format(pick(words), pick(words)) for _ in range(30)),
        "links": "\n".join(f"https://www.{pick(names).lower()}{k}.example/item/{pick(goods)}?id={rng.randrange(9999)}" for k in range(25)),
        "markdown": "\n".join(f"[{pick(words)}](http://{pick(names).lower()}.test/{k})" for k in range(25)),
        "html": "\n".join(f'<li><a href="http://{pick(names).lower()}{k}.test/p/{k}.html">{pick(words)}</a></li>' for k in range(25)),
        "tags": " ".join(f"#{pick(names).lower()}{pick(goods)}" for _ in range(70)),
        "goods": ", ".join(f"{pick(names)} {pick(goods)}" for _ in range(70)),
        "catalogue": "\n".join(f"{pick(names)} {pick(goods)} | SKU-{rng.randrange(10000, 99999)} | {rng.randrange(10, 900)}.{rng.randrange(10, 99)} | in stock" for _ in range(30)),
        "french": " ".join(pick(["Meilleur {0} {1} {0}.", "Acheter {0} {1} en ligne!", "{0} et {1} et {0}."]).format(pick(["poche", "kit enzyme", "colonne"]), pick(["poche", "kit enzyme", "colonne"])) for _ in range(40)),
    }
    spam["mixed"] = PROSE + "\n" + spam["links"] + "\n" + spam["list"]
    fine = {
        "prose": PROSE * 3,
        "short": "The chain was measured 6 times. For this chain we see no change.",
        "log": "\n".join(f"0{k % 10}:{rng.randrange(10, 59)}:{rng.randrange(10, 59)} INFO loaded {rng.randrange(1000, 99999)} points in {rng.randrange(1, 9)}.{rng.randrange(10, 99)}s" for k in range(30)),
        "table": "\n".join(f"A | {rng.randrange(400)} | {pick(['GLY', 'TYR', 'LYS'])} | {rng.uniform(-60, 60):.3f} | {rng.uniform(-60, 60):.3f} | {rng.random():.3f}" for _ in range(30)),
        "sequence": ">chain A\n" + "\n".join("".join(pick("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) for _ in range(10)),
        "references": PROSE * 3 + "\nReferences\n" + "\n".join(f"[{k}] https://www.{pick(names).lower()}.example/p/{k}" for k in range(4)),
        "chinese": "我们在采样表面之前去掉了水分子。蛋白的口袋位于该残基附近，得分为三十，排名第七。" * 5,
    }
    return spam, fine


def test_pages(spark):
    spam, fine = pages()
    base = [(1000 + k, t, "en") for k, t in enumerate(ordinary(200))]
    rows = base + [(k, t, "fr" if n == "french" else None if n == "tags" else "en") for k, (n, t) in enumerate(spam.items())] + [(100 + k, t, "zh" if n == "chinese" else "en") for k, (n, t) in enumerate(fine.items())]
    rows += [(200, None, "en"), (201, "", None), (202, "  \n ", "en"), (203, spam["list"] * 400, "en"), (0, spam["list"], "en"), (None, spam["list"], "en"), (204, "x" * 200_000, "en")]
    df = spark.createDataFrame(rows, "doc long, body string, language string").selectExpr("*", "'a' AS i", "1 AS n", "2 AS share", "'q' AS lang")
    got = {r["doc"] for r in stuffing.stuffed_pages(df, "doc", "body", "language").collect()}
    assert {n for k, n in enumerate(spam) if k not in got} == set()
    assert {n for k, n in enumerate(fine) if 100 + k in got} == set()
    assert got - set(range(len(spam))) <= {203, 204} and 203 in got
    assert stuffing.stuffed_pages(df.limit(0), "doc", "body", "language").count() == 0


def test_measures():
    spoken, poor = stuffing.measure(PROSE * 2)
    assert len(spoken) > 2 and not poor and all(0 < r[2] < 0.9 for r in spoken)
    spoken, poor = stuffing.measure("gene synthesis, " * 100)
    assert not spoken and sum(b[0] for b in poor) == 1600 and all(b[3] < 0.2 for b in poor[1:])
    assert stuffing.measure("x" * 1000) == ([], [])  # an unbroken run is data
    a = "One two three four five six. "
    assert stuffing.sentences(a + "Buy kit online kit now kit. " + a) == [(0, 28), (56, 85)]
    text = "ab cd\n" * 400
    edges = stuffing.cut(text)
    assert edges[0] == 0 and edges[-1] == len(text) and all(text[e] == "\n" for e in edges[1:-1]) and sorted(set(edges)) == edges


FOREIGN = {
    "polish": "Zmierzyliśmy powinowactwo związku w drugim teście i okazało się niższe niż poprzednio. Pętla zamyka się nad ligandem, gdy związany jest jon wapnia, czego nie widzieliśmy w pierwszym przebiegu. Nikt nie wyjaśnił, dlaczego plik etykiet nie wymienia żadnej z tych dwóch reszt.",
    "turkish": "Bileşiğin ilgisini ikinci bir deneyde ölçtük ve öncekinden daha düşük çıktı. Kalsiyum iyonu bağlandığında halka ligandın üzerine kapanıyor, bunu ilk çalıştırmada görmemiştik. Etiket dosyasının bu iki kalıntıdan neden hiçbirini listelemediğini kimse açıklamadı.",
    "russian": "Мы измерили сродство соединения во втором опыте, и оно оказалось ниже прежнего. Петля закрывается над лигандом, когда связан ион кальция, чего мы не видели в первом прогоне. Никто не объяснил, почему файл меток не содержит ни одного из этих двух остатков.",
    "finnish": "Mittasimme yhdisteen affiniteetin toisessa kokeessa, ja se oli aiempaa alhaisempi. Silmukka sulkeutuu ligandin päälle, kun kalsiumioni on sitoutunut, mitä emme nähneet ensimmäisessä ajossa. Kukaan ei ole selittänyt, miksi tiedosto ei mainitse kumpaakaan.",
    "japanese": "私たちは二回目の実験で化合物の親和性を測定した。カルシウムイオンが結合すると、ループがリガンドの上に閉じる。これは最初の実行では見られなかった。なぜラベルファイルにその残基がないのか、誰も説明していない。",
}


def test_pages_of_other_languages(spark):
    """No word list: ordinary pages of languages that the corpus hardly has are clean, and keyword lists in them are found."""
    base = [(1000 + k, t, "en") for k, t in enumerate(ordinary(200))]
    fine = [(k, t, n[:2] if k % 2 else None) for k, (n, t) in enumerate(FOREIGN.items())]
    spam = [(100, "tanie odczynniki, zestaw enzymów, tanie odczynniki, Tanie Odczynniki, synteza genów, " * 12, "po"), (101, " ".join(["дешёвые реагенты", "Дешёвые Реагенты", "купить набор", "дешёвые реагенты"][k * k % 4] for k in range(60)), None), (102, "抗体価格、試薬セット、抗体価格、試薬販売、" * 20, "ja")]
    got = {r["doc"] for r in stuffing.stuffed_pages(spark.createDataFrame(base + fine + spam, "doc long, body string, lang string"), "doc", "body", "lang").collect()}
    assert got == {100, 101, 102}


def test_classes_without_sentences_take_the_usual_ratio(spark):
    df = spark.createDataFrame([(1, "gene synthesis, " * 100, "en"), (2, "12.5 17.1 18.9 " * 40, "en")], "doc long, body string, lang string")
    assert [r["doc"] for r in stuffing.stuffed_pages(df, "doc", "body", "lang").collect()] == [1]
