"""The learned tagger on sentences labelled by hand, and the blacklist on lemma and surface form."""

import pytest
from pyspark.sql import functions as F

from textpool.operators import aspects as AS
from textpool.operators import tagging as TG
from textpool.operators.scoring import PairShapeScorer

# word/TAG; N noun, P proper noun, V verb, J adjective, R adverb, O other
LEARN = """
Telefon/N çok/R hızlı/J çalışıyor/V
Ekran/N parlak/J ama/O batarya/N zayıf/J
Kargo/N geç/R geldi/V
Satıcı/N paketi/N özenle/R gönderdi/V
Kulaklığın/N sesi/N harika/J
Ürünün/N kalitesi/N kötü/J çıktı/V
Fiyatı/N biraz/R yüksek/J
Kamera/N gece/N iyi/J çekmiyor/V
Ahmet/P bu/O telefonu/N dün/R aldı/V
Servis/N personeli/N kibar/J davrandı/V
Yemekler/N lezzetli/J fakat/O servis/N yavaş/J
Garson/N siparişi/N unuttu/V
Otelin/N odaları/N temiz/J
Odanın/N manzarası/N güzel/J
Kahvaltı/N çeşitleri/N yeterli/J değildi/V
İstanbul/P büyük/J bir/O şehir/N
Ayşe/P kitabı/N hemen/R okudu/V
Kitabın/N kapağı/N yırtık/J geldi/V
Bilgisayar/N sürekli/R donuyor/V
Klavye/N tuşları/N sert/J
Ben/O bu/O ürünü/N beğendim/V
Sen/O hangi/O rengi/N istedin/V
Film/N çok/R uzun/J sürdü/V
Oyuncular/N iyi/J oynadı/V
Müziği/N herkes/O sevdi/V
Ankara/P soğuk/J bir/O şehir/N
Mehmet/P arabayı/N yavaş/R sürdü/V
Arabanın/N motoru/N sessiz/J çalışıyor/V
Doktor/N hastayı/N dikkatle/R dinledi/V
Hastanenin/N koridorları/N kalabalık/J
Uygulama/N sık/R kapanıyor/V
Güncelleme/N hataları/N düzeltti/V
Şarj/N aleti/N hızlı/R bozuldu/V
Kumaşı/N ince/J ve/O yumuşak/J
Elbisenin/N rengi/N soldu/V
Ayakkabı/N ayağımı/N sıktı/V
Mağaza/N çalışanları/N ilgisiz/J
Zeynep/P çantayı/N geri/R gönderdi/V
Çantanın/N fermuarı/N kırık/J
Teslimat/N süresi/N kısa/J
""".strip().splitlines()
JUDGE = """
Tabletin/N ekranı/N çok/R parlak/J
Batarya/N hızlı/R bitiyor/V
Garsonlar/N kibar/J davrandı/V
Otelin/N bahçesi/N büyük/J ve/O temiz/J
Selin/P bu/O filmi/N beğendi/V
Paketin/N kutusu/N yırtık/J geldi/V
Uygulamanın/N tasarımı/N güzel/J
Müşteri/N hizmetleri/N yavaş/J çalışıyor/V
Ben/O İzmir/P otelini/N sevdim/V
Kameranın/N kalitesi/N düşük/J
Yemeklerin/N tadı/N iyi/J
Satıcı/N ürünleri/N geç/R gönderdi/V
""".strip().splitlines()
TAGS = {"N": "NOUN", "P": "PROPN", "V": "VERB", "J": "ADJ", "R": "ADV", "O": "OTHER"}


def sentences(lines):
    return [[(w, TAGS[t]) for w, t in (x.rsplit("/", 1) for x in line.split())] for line in lines]


@pytest.fixture(scope="module")
def tagger(spark):
    rows = [(i, j, w, t) for i, s in enumerate(sentences(LEARN)) for j, (w, t) in enumerate(s)]
    return TG.fit_hmm(spark.createDataFrame(rows, "sentence long, position int, word string, tag string"))


def test_noun_f1_on_sentences_that_were_not_learned(spark, tagger):
    held = sentences(JUDGE)
    texts = spark.createDataFrame([(i, " ".join(w for w, _ in s) + ".") for i, s in enumerate(held)], "id long, text string")
    got = {r.id: [(t.token, t.pos) for t in r.t] for r in texts.select("id", TG.tag_tokens(F.col("text"), tagger).alias("t")).collect()}
    hit = wrong = missed = 0
    for i, sentence in enumerate(held):
        assert [w for w, _ in got[i]] == [w for w, _ in sentence]
        for (_, want), (_, pos) in zip(sentence, got[i], strict=True):
            want, pos = want in TG.NOUN_TAGS, pos in TG.NOUN_TAGS
            hit, wrong, missed = hit + (want and pos), wrong + (pos and not want), missed + (want and not pos)
    f1 = 2 * hit / (2 * hit + wrong + missed)
    capitals = [w[0].isupper() for s in held for w, _ in s]
    wants = [t in TG.NOUN_TAGS for s in held for _, t in s]
    by_capital = 2 * sum(a and b for a, b in zip(capitals, wants, strict=True)) / (sum(capitals) + sum(wants))
    print("noun F1", round(f1, 3), "by capital letter", round(by_capital, 3))
    assert f1 >= 0.85 and f1 > by_capital + 0.1


def test_neighbours_decide_a_word_with_two_tags(spark):
    rows = [(i, j, w, t) for i, s in enumerate([[("a", "X"), ("saw", "NOUN")], [("they", "Y"), ("saw", "VERB")]] * 3) for j, (w, t) in enumerate(s)]
    tag = TG.fit_hmm(spark.createDataFrame(rows, "sentence long, position int, word string, tag string"))()
    assert [p for _, _, p, _ in tag("a saw. they saw")] == ["X", "NOUN", "Y", "VERB"]


def test_blacklist_holds_for_lemma_and_surface_stop_words_and_length(spark):
    tagger = TG.SuffixTagger(("a", "e", "ı", "i", "r", "n", "v"), stop_words=("kendi",))
    text = "günlerde saatler ekran Ekran ekran ev kendi Konu masa"
    row = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(
        TG.aspects_of_tokens(TG.tag_tokens(F.col("text"), tagger)).alias("a")).collect()
    # gün-lerde and saat-ler by their lemma, konu by its surface, ev by its length, kendi as a stop word
    assert [r.a for r in row] == [["ekran", "Ekran", "masa"], [], []]


@pytest.mark.parametrize("word,lemma", [("odaları", "oda"), ("telefonlardan", "telefon"), ("ev", "ev"), ("evler", "evler"), ("kutusu", "kutu")])
def test_lemmas(word, lemma):
    assert TG.suffix_lemma(word, TG.lemma_pattern(TG.LEMMA_SUFFIXES)) == lemma


def test_tagged_aspects_are_scored(spark, tagger):
    items = spark.createDataFrame([("1", "Kargo geç geldi."), ("2", "ve ama")], "id string, text string")
    aspects = TG.aspects_of_tokens(TG.tag_tokens(F.col("text"), tagger))
    rows = AS.aspect_rows(items, PairShapeScorer(), aspects=aspects).collect()
    assert {(r.id, r.detected_aspect) for r in rows} == {("1", "Kargo"), ("2", AS.GENERAL)}
