import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.sentences import p5_found, sentence_rows, sentences

CASES = [
    "The run starts at 9 a.m. and ends by 5 p.m.|Dr. Temhald and J. K. Fespesh agree, etc.|Nobody knows 3.14 or v2.9.8.",
    "\"Stop!\" shouts the scheduler.|He says, \"Draw it before noon.\"|(The rule is proved in App. C.)|See Fig. 43 and Sec. 2.7 (pp. 9 f.) there.",
    "It goes on and on... and then stops.|It is over...|Was it 1.87 or 2.64?!|It spread to the U.S. and beyond.|St. Velbru College knows.",
    "3. The quiz begins.|It has one line\nand goes on; then: more.|Missing blank.|Only 51 of them.",
    "Am 3. Mai wurde die Tabelle (vgl. Abb. 36, S. 13) neu berechnet.|Viele Größen, z. B. die Matrix, liegen bei ca. 9 MB.|„Warum fehlt sie?“ lautet die Frage.|Im Heft steht: „Zuerst zeichnen.“|Danach nicht.",
    "Algunas notas, p. ej. la cola, valen 31.98 puntos.|¡La tabla se borra!|«¿Por qué falta?» es la pregunta.|El cuaderno dice: «Primero dibuja.»|El Dr. Veldok y la Sra. Garmira explican la pág. 67 del vol. 22.",
    "“不要死记模型！”这句话在第 48 讲里反复出现。|他把“秩。引理。定理。”三个词写在同一行。|讲义写道：“先画出事件，再列出语篇。”|如 e.g. 一栏所示，取值是 35.51.|柯多公式成立！！|题干是《真的够用吗？》，答案写在 oso-38.mdx 里。|留到第 51 讲再谈……|按 a.m. 与 p.m. 统计。",
    "先生は「描け！」と言って黒板に戻った。|「零にならない。」と書かれている。|tesk-37.jsonを開くと、v4.7.8が確認できる。|なぜ先に読むのか？",
    "Он живёт в г. Москве на ул. Ленина, д. 5, т. е. в центре.|Это было в 1999 г.|Потом он уехал.|См. рис. 3 и табл. 4.|А. С. Пушкин родился в Москве!|Купил хлеб, молоко и т. д.|Вечером вернулся.",
    "Cf. p. 12, c.-à-d. la fin.|La ville fut prise en 52 av. J.-C. Rome l'a gardée.|M. Dupont est dans la file.|« Pourquoi pas ? » est la question.",
    "یہ پہلا جملہ ہے۔|یہ دوسرا جملہ ہے۔|کیا یہ سوال ہے؟|ختم۔",
    "ይህ የመጀመሪያ ነው።|ይህ ሁለተኛ ነው።",
    "នេះជាប្រយោគទីមួយ។|នេះជាប្រយោគទីពីរ។",
    "Սա առաջին նախադասությունն է։|Սա երկրորդն է։",
    "ဒါက ပထမ ဝါကျ ဖြစ်တယ်။|ဒါက ဒုတိယ ဖြစ်တယ်။",
    "วันนี้อากาศดีมากครับ|ผมไปตลาด ซื้อปลาและผัก|แต่ไม่ได้ซื้อข้าว",
    "डॉ. Ostdok ने कहा, \"पहले अभ्यास बनाओ।\"|सीमा का मान 9.9 है।|क्यों पढ़ना चाहिए?|यह अंत है।",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    wanted = case.split("|")
    glue = "" if any(c > "⺀" and c < "ꀀ" for c in case) or "។" in case else " "
    text = glue.join(wanted)
    assert [text[a:b] for a, b in sentences(text)] == wanted


def test_titles_blanks_and_dirt():
    text = "  Page table at a glance\r\n \r\nNo end mark here\n\n🗂 One.  Two​ lines\xa0stay. Ｄr. Ｘu ｃame.\n"
    assert [text[a:b] for a, b in sentences(text)] == ["Page table at a glance", "No end mark here", "🗂 One.", "Two​ lines\xa0stay.", "Ｄr. Ｘu ｃame."]
    assert sentences("") == sentences(" \n\t　") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1.!?…。！？ \n\"“”„«»「」()（）中の।​,é", max_size=60))
def test_cover(text):
    """Sentences are in order, apart, begin and end with something shown, and leave out only blanks and invisible characters."""
    end = 0
    for a, b in sentences(text):
        assert end <= a < b <= len(text) and not text[end:a].strip(" \n​") and not text[a].isspace() and not text[b - 1].isspace()
        end = b
    assert not text[end:].strip(" \n​")


def test_tables(spark):
    rows = [("content", 1, 0, 0, None, 1), ("content", 2, 0, 0, "", 1), ("content", 3, 0, 0, "One. Two.", 1), ("content", 3, 0, 0, "One. Two.", 1)]
    df = spark.createDataFrame(rows, "kind string, item_id long, sense_no int, example_no int, text string, sent_start int")
    assert sorted(tuple(r) for r in sentence_rows(df).collect()) == [("content", 3, 0, 0, 0, 4)] * 2 + [("content", 3, 0, 0, 5, 9)] * 2
    assert sentence_rows(df.limit(0)).collect() == []
    found = p5_found(spark, "/root/testdata/sf0.001")
    assert found.columns == ["kind", "item_id", "sense_no", "example_no", "sent_start", "sent_end"] and {r.kind for r in found.collect()} == {"content", "example"}


def test_list_numbers_and_empty_lines():
    text = "1. One begins. 2. Two\nb) goes on.\n\n(iv) Three\n \nend"
    assert [text[a:b] for a, b in sentences(text)] == ["1. One begins.", "2. Two\nb) goes on.", "(iv) Three", "end"]
