"""Names in sentences that the rules weren't written for: recall and precision. README has the figures."""

from casemesh.llm import private

# Sentences of other wordings than those of the test data, written before the rules were run on them and not changed since.
SENTENCES = (
    ("原告於民國110年間經友人張志豪介紹認識被告。", ["張志豪"]),
    ("被告辯稱係受訴外人林佳蓉之託代為保管。", ["林佳蓉"]),
    ("告訴人吳秀英指訴歷歷，核與證人周文雄證述相符。", ["吳秀英", "周文雄"]),
    ("被害人許家瑜因車禍送醫不治。", ["許家瑜"]),
    ("系爭房屋原為其父蔡金水所有。", ["蔡金水"]),
    ("被告乃將系爭車輛交由鄭凱文駕駛。", ["鄭凱文"]),
    ("上訴人之配偶洪淑芬到庭結證屬實。", ["洪淑芬"]),
    ("經查，該支票係由謝明宗簽發後背書轉讓。", ["謝明宗"]),
    ("被上訴人委任之代理人邱怡君女士到場。", ["邱怡君"]),
    ("房東廖國棟向原告收取押租金新臺幣三萬元。", ["廖國棟"]),
    ("原告之長子賴柏翰與次女賴思妤均為繼承人。", ["賴柏翰", "賴思妤"]),
    ("依證人即鄰居徐美鳳所述，當晚並無爭吵聲。", ["徐美鳳"]),
    ("嗣羅建成未依約給付價金。", ["羅建成"]),
    ("被告與沈冠宇共同經營餐廳。", ["沈冠宇"]),
    ("匯款人為曾雅婷，匯款日期為3月2日。", ["曾雅婷"]),
    ("Mary Ann Smith於警詢時陳稱遭詐騙。", ["Mary Ann Smith"]),
    ("證人John Miller到庭作證。", ["John Miller"]),
    ("聲請人歐陽志遠主張其為所有權人。", ["歐陽志遠"]),
    ("告訴人瓦歷斯．諾幹於本院審理時陳明願意和解。", ["瓦歷斯．諾幹"]),
    ("其母彭玉蘭（電話：0911-222-333）代收。", ["彭玉蘭"]),
    ("對於相對人簡志明之抗告應予駁回。", ["簡志明"]),
    ("本件買賣係呂宗翰居間仲介。", ["呂宗翰"]),
    ("法官陳怡如認為原告之訴無理由。", []),
    ("原告主張被告應給付違約金。", []),
    ("被告抗辯時效業已完成，原告否認之。", []),
    ("上訴人於本院審理時提出會議紀錄為證。", []),
    ("大同電機股份有限公司簽收貨物。", []),
    ("兩造於言詞辯論時均表示無意見。", []),
    ("應由金融監督管理委員會依法處理。", []),
    ("證人均已到庭陳述，被告亦無異議。", []),
    ("被告於偵查中供稱貨款業已付清。", []),
    ("原告另向保險公司請求理賠。", []),
    ("鑑定人即土木技師公會函覆本院。", []),
    ("訴訟代理人王文彥律師到庭陳述意見。", []),
)


def rates():
    hit = wanted = given = 0
    for text, names in SENTENCES:
        got = [text[a:b] for kind, a, b in private.find(text) if kind == "name"]
        hit += len(set(got) & set(names))
        wanted += len(names)
        given += len(got)
    return hit / wanted, hit / max(given, 1)


def test_held_out_names():
    recall, precision = rates()
    assert recall >= 0.7 and precision >= 0.9
