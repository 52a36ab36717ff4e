"""Rule constants.  All are fixed values: results depend on their exact text."""

from __future__ import annotations

# What begins a vehicle's block.
BLOCK_PREFIXES = ("TC-web", "ANS", "USS")

# Venue names that begin a block when they stand alone.
VENUES = ("横浜", "兵庫", "東京", "名古屋", "大阪", "福岡", "札幌", "仙台", "広島", "北海道", "静岡", "新潟", "岡山", "群馬", "東北", "関東", "中部", "関西", "九州", "Tohoku", "Tokyo", "Kanto", "Kansai")

# A line with one of these is a header or footer.
FOOTER_MARKERS = ("三菱ＵＦＪ", "普通", "口座名", "振込先", "下段", "消費税", "開催日", "出品No", "会場", "年", "式", "車", "成約", "落札", "御支払", "御請求", "御取引", "本日差引", "前回残高", "入出金", "差引御請求", "今回取引", "その他取引", "前回残高", "税率区分", "登録番号", "発行元", "ＡＡ回", "FAX", "電話", "〒", "神奈川県", "ｵｰｸｼｮﾝ計算書", "オークション計算書", "ﾘｻｲｸﾙ", "預託金", "自税", "相当額", "出品料", "成約料", "落札料", "備  考", "備考")

# A line with one of these belongs to transport or a summary.
TRANSPORT_KEYWORDS = ("輸送料", "輸送", "送料", "合計", "合算", "合計金額", "振込", "銀行", "支店", "その他", "非課税")

# Fixed value: the form of address on a letter head.
ADDRESSEE = "御中"

# Patterns.
CHASSIS = "[A-Z0-9]+-[0-9]+"
STRICT_CHASSIS = "[A-Z][A-Z0-9]*-[0-9]{4,}"
DATE = "[0-9]{1,2}/[0-9]{1,2}"
PACKED_DATE = "[0-9]{2}/[0-9]{2}[0-9]{5,}"
LOT = "^[0-9]{3,5}$"
PACKED = "^[0-9]{10,}$"
SUBTOTAL = "^[0-9]{5,7}$"
JS_SPACE = r"[\x{0009}-\x{000d}\x{0020}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
JAPANESE = r"[\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ff00}-\x{ff9f}\x{4e00}-\x{9faf}\x{3400}-\x{4dbf}]"

# Words that classify a document.
AUCTION_PRIMARY = ("TC-web", "ANS", "USS")
AUCTION_SECONDARY = ("オークション計算書", "ｵｰｸｼｮﾝ計算書", "出品No", "落札", "成約")
PURCHASE_KEYWORDS = ("売買", "買主", "売主", "購入", "販売", "車両", "自動車")
TYPE_CASCADE = (("BILLING", "請求書", "INVOICE"), ("PURCHASE_ORDER", "注文書", "PURCHASE ORDER"), ("RECEIPT", "領収書", "RECEIPT"), ("PACKING_LIST", "納品書", "PACKING LIST"))

# Names of areas.
AREAS = {"横浜": "Yokohama", "兵庫": "Hyogo", "東京": "Tokyo", "名古屋": "Nagoya", "大阪": "Osaka", "福岡": "Fukuoka", "札幌": "Sapporo", "仙台": "Sendai", "広島": "Hiroshima", "北海道": "Hokkaido", "静岡": "Shizuoka", "新潟": "Niigata", "岡山": "Okayama", "群馬": "Gunma", "千葉": "Chiba", "埼玉": "Saitama", "京都": "Kyoto", "神戸": "Kobe"}

# Weights of the fields in an evaluation.
FIELD_WEIGHTS = {"chassis": "0.30", "bid": "0.20", "total": "0.20", "date": "0.10", "auction": "0.10", "lot_number": "0.10"}

#: Full-width digits and capitals and what they become, by their code points.
FULL_WIDTH = "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B))))
HALF_WIDTH = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of ``words``, none of which has a special character."""
    return "|".join(dict.fromkeys(words))
