"""Vocabularies and lookup tables.

The values below are fixed: results only match when they are exactly these words, patterns and
numbers. They are kept as plain text, one table per rule set, and compiled into columns elsewhere.
Rule sets that are longer than a page are parameters (see ``functions.classify``).
"""

from __future__ import annotations

# --- fixed values: origin words, in order of precedence ---------------------------------------
ORIGINS = [
    "Ethiopia", "Kenya", "Colombia", "Panama", "Peru", "Brazil", "Bolivia",
    "Rwanda", "Burundi", "Guatemala", "Costa Rica", "El Salvador", "Honduras",
    "Ecuador", "Mexico", "Nicaragua", "Yemen", "India", "Indonesia", "Uganda",
    "Tanzania", "Madagascar", "China", "Taiwan", "Thailand", "Myanmar",
    "エチオピア", "ケニア", "コロンビア", "パナマ", "ペルー", "ブラジル",
    "ルワンダ", "ブルンジ", "グアテマラ", "コスタリカ", "エルサルバドル",
    "ホンジュラス", "エクアドル", "メキシコ", "インドネシア", "イエメン",
]

# --- fixed values: process words and their labels, compound terms first -------------------------
PROCESSES = [
    ("anaerobic natural", "Anaerobic Natural"),
    ("natural anaerobic", "Anaerobic Natural"),
    ("anaerobic washed", "Anaerobic Washed"),
    ("washed anaerobic", "Anaerobic Washed"),
    ("嫌気性ナチュラル", "Anaerobic Natural"),
    ("アナエロビックナチュラル", "Anaerobic Natural"),
    ("嫌気性ウォッシュ", "Anaerobic Washed"),
    ("アナエロビックウォッシュ", "Anaerobic Washed"),
    ("anaerobic", "Anaerobic"),
    ("carbonic", "Carbonic Maceration"),
    ("thermal shock", "Thermal Shock"),
    ("honey", "Honey"),
    ("natural", "Natural"),
    ("washed", "Washed"),
    ("ナチュラル", "Natural"),
    ("ウォッシュ", "Washed"),
    ("ハニー", "Honey"),
]

# --- fixed values: product types that are left out of a shop feed ------------------------------
SKIPPED_PRODUCT_TYPES = [
    "gear", "equipment", "merch", "mug", "gift card", "apparel", "subscription",
]

# --- fixed values: display names of origins; an empty origin counts as a blend ------------------
ORIGIN_NAMES = {
    "ethiopia": "エチオピア", "kenya": "ケニア", "colombia": "コロンビア", "panama": "パナマ",
    "peru": "ペルー", "brazil": "ブラジル", "bolivia": "ボリビア", "rwanda": "ルワンダ",
    "burundi": "ブルンジ", "guatemala": "グアテマラ", "costa rica": "コスタリカ",
    "el salvador": "エルサルバドル", "honduras": "ホンジュラス", "ecuador": "エクアドル",
    "mexico": "メキシコ", "nicaragua": "ニカラグア", "yemen": "イエメン", "india": "インド",
    "indonesia": "インドネシア", "uganda": "ウガンダ", "tanzania": "タンザニア",
    "madagascar": "マダガスカル", "china": "中国", "taiwan": "台湾", "thailand": "タイ",
    "myanmar": "ミャンマー",
}
BLEND = "ブレンド"

# --- fixed values: origin groups (patterns over the display name) --------------------------------
ORIGIN_GROUPS = [
    ("africa", "エチオピア|ケニア|ルワンダ|ブルンジ|タンザニア"),
    ("latam", "コロンビア|ブラジル|グアテマラ|コスタリカ|メキシコ|ペルー|パナマ|エルサルバドル"
              "|ホンジュラス|ボリビア|ニカラグア|エクアドル"),
    ("asia", "インドネシア|ベトナム|インド|中国|タイ|東ティモール|パプア"),
]

# --- fixed values: process classes, first match wins, and their order in listings ----------------
PROCESS_CLASSES = [
    ("anatural", r"Anaerobic\s*Natural"),
    ("awashed", r"Anaerobic\s*Washed"),
    ("anatural", "Anaerobic"),
    ("honey", "Honey"),
    ("natural", "Natural"),
    ("washed", "Washed"),
]
PROCESS_ORDER = ["washed", "natural", "honey", "anatural", "awashed", "other"]

# --- fixed values: tasting-note label and flavour vocabulary of the note extractor ---------------
NOTE_LABEL = (
    r"(?iU)^[\s\-–・*]*(?:tasting\s*notes?|flavou?r\s*notes?|cupping\s*notes?|flavou?r\s*profile"
    r"|tasting|notes?|フレーバー(?:ノート)?|テイスティング\s*ノート|カッピング\s*ノート|風味|味わい|フレーバ)"
    r"\s*[:：]?\s*(.*)$"
)
NOTE_WORDS = (
    r"(?iU)berr|cassis|cherry|plum|straw|blueberr|raspberr|currant|acerola|hibiscus"
    r"|citrus|lemon|lime|orange|grapefruit|mandarin|bergamot|yuzu"
    r"|floral|jasmine|rose|tea\b|lavender|chamomile|blossom"
    r"|tropical|pineapple|mango|lychee|passion|guava|melon|peach|apricot|papaya"
    r"|chocolate|cocoa|cacao|nut|almond|hazelnut|caramel|toffee|brown\s*sugar|honey|vanilla|malt"
    r"|molasses|syrup"
    r"|apple|pear|grape|fig|date|raisin|tamarind|rhubarb|lemongrass|nougat|cane|spice|cinnamon"
    r"|ベリー|カシス|苺|いちご|ストロベリー|チェリー|プラム|柑橘|レモン|オレンジ|グレープフルーツ"
    r"|花|ジャスミン|紅茶|ローズ|トロピカル|パイナップル|マンゴー|ライチ|ピーチ|白桃|杏"
    r"|チョコ|カカオ|ココア|ナッツ|キャラメル|黒糖|蜂蜜|はちみつ|バニラ|モルト|林檎|りんご|ぶどう"
)

# --- fixed values: flavour families (name, depth weight, character weight, vocabulary) -----------
FLAVOUR_FAMILIES = [
    ("berry", -6, 10,
     r"ベリー|苺|いちご|ストロベリー|ラズベリー|ブルーベリー|カシス|クランベリー|赤い果実|レッドフルーツ"
     r"|プラム|チェリー|さくらんぼ|アセロラ|ハイビスカス|レーズン|干しぶどう|イチジク|red\s*fruit|berr"
     r"|cassis|currant|cherry|plum|acerola|hibiscus|rhubarb|raisin|fig\b|date\b|pomegranate"),
    ("tropical", 0, 14,
     r"トロピカル|パイナップル|マンゴー|ライチ|パッション|パパイヤ|グァバ|グアバ|メロン|マスカット|白ぶどう"
     r"|ピーチ|白桃|杏|アプリコット|スターフルーツ|バナナ|tropical|pineapple|mango|lychee|passion|guava"
     r"|papaya|melon|muscat|peach|apricot|starfruit|banana|nectarine"),
    ("floral", -10, -4,
     r"フローラル|花|ジャスミン|ローズ|薔薇|バラ|紅茶|ティー|ベルガモット|アールグレイ|オレンジフラワー"
     r"|カモミール|ラベンダー|すみれ|バイオレット|レモングラス|ハーブ|floral|jasmine|rose\b|blossom|tea\b"
     r"|bergamot|earl\s*grey|lavender|chamomile|violet|lemongrass|herbal|citronella"),
    ("citrus", -8, -6,
     r"柑橘|シトラス|レモン|ライム|オレンジ|グレープフルーツ|マンダリン|みかん|ゆず|すだち|グレフル|青りんご"
     r"|青リンゴ|リンゴ酸|citrus|lemon|lime|orange|grapefruit|mandarin|yuzu|clementine|tangerine"
     r"|green\s*apple|crisp"),
    ("choco", 14, -2,
     r"チョコ|カカオ|ココア|ナッツ|アーモンド|ヘーゼル|クルミ|キャラメル|ブラウンシュガー|黒糖|きび砂糖|蜂蜜"
     r"|はちみつ|バニラ|モルト|麦芽|スパイス|シナモン|クローブ|香ばし|ロースト|トフィー|糖蜜|ヌガー|chocolate"
     r"|cocoa|cacao|nut|almond|hazelnut|walnut|caramel|toffee|brown\s*sugar|molasses|honey|vanilla"
     r"|malt|spice|cinnamon|nougat|cane\s*sugar|praline|fudge"),
]
FERMENT_WORDS = (
    r"アナエロビック|嫌気|発酵|ファンキー|ワイン|カルバドス|ラム|洋酒|シナモン漬け|コーファーメント|anaerobic"
    r"|ferment|co-?ferment|funky|boozy|wine|winey|rum|whisk|brandy|cider|kombucha|natto|savou?ry|umami"
)

# --- fixed values: rare-lot patterns --------------------------------------------------------------
GEISHA = r"(?iU)\b(geisha|gesha)\b|ゲイシャ|ゲシャ"
SIDRA = r"(?iU)\bsidra\b|シドラ"
BLEND_WORD = r"(?iU)\bblend\b|ブレンド"
AWARD = r"(?iU)\bCOE\b|cup\s*of\s*excellence|カップ[・\s]?オブ[・\s]?エクセレンス"
AWARD_RANK = r"(?iU)#\s*(\d{1,2})\b|\b(\d{1,2})\s*(?:st|nd|rd|th)\s*place|\b(\d{1,2})\s*位"
ESTATE = r"(?iU)\bCGLE\b|caf[eé]\s*granja|granja\s+la\s+esperanza|カフェ[・\s]?グランハ"
ESTATE_FARM = r"(?iU)cerro\s*azul|セロ[・\s]?アスール"
ESTATE_LOOKALIKE = r"(?iU)granja\s+para[ií]so"
DIGEST_RARE = r"(?iU)\b(geisha|gesha|sidra)\b|ゲイシャ|ゲシャ|シドラ|cup of excellence|\bcoe\b"

# --- fixed values: platform signs in landed home pages, first match wins ---------------------------
PLATFORM_SIGNS = [
    ("Shopify", r"cdn\.shopify\.com|Shopify\.theme|shopify-features"),
    ("BASE", r"base\.ec|thebase\.in|base-ec2?\.akamaized"),
    ("STORES.jp", r"stores\.jp|storesstatic"),
    ("Squarespace", r"squarespace\.com|static1\.squarespace"),
    ("Wix", r"wixstatic\.com|_wixCIDX|wix\.com"),
    ("BigCommerce", r"bigcommerce\.com"),
    ("Square Online", r"square(up)?\.com|squarecdn\.com"),
    ("EC-CUBE", r"ec-cube|eccube"),
    ("カラーミー", r"colorme|shop-pro\.jp"),
    ("MakeShop", r"makeshop\.jp"),
    ("futureshop", r"future-shop\.jp|fs-storage"),
    ("Magento", r"Magento|mage-init"),
    ("PrestaShop", r"prestashop"),
    ("WooCommerce", r"woocommerce"),
    ("WordPress", r"wp-content|wp-json"),
]

# --- fixed values: yen per unit of a currency ------------------------------------------------------
YEN_RATES = {
    "JPY": 1, "USD": 150, "NOK": 14.5, "DKK": 22, "EUR": 165, "AUD": 100, "GBP": 195, "SEK": 14,
    "CAD": 108, "NZD": 90, "SGD": 112, "ISK": 1.1, "KRW": 0.11, "HKD": 19, "THB": 4.3, "CNY": 21,
    "TWD": 4.7, "VND": 0.006, "IDR": 0.0092, "MYR": 33, "PHP": 2.6, "INR": 1.8, "COP": 0.037,
    "BRL": 27, "MXN": 8.3, "CRC": 0.29, "ZAR": 8.2, "ETB": 1.25, "KES": 1.15, "RWF": 0.11,
    "AED": 41, "TRY": 3.75, "CZK": 6.8, "CHF": 185, "PLN": 41, "HUF": 0.43, "PEN": 40,
    "GTQ": 19.5, "SAR": 40, "ILS": 40,
}
# Currencies taken from a live rate payload; the others keep their rate above.
LIVE_RATE_CURRENCIES = [
    "USD", "NOK", "DKK", "EUR", "AUD", "GBP", "SEK", "CAD", "NZD", "SGD", "ISK", "KRW", "HKD",
    "THB", "CNY", "IDR", "MYR", "PHP", "INR", "BRL", "MXN", "ZAR", "TRY", "CZK", "CHF", "PLN",
    "HUF", "ILS",
]
CURRENCY_SYMBOLS = {
    "JPY": "¥", "USD": "$", "NOK": "kr ", "DKK": "kr ", "EUR": "€", "AUD": "A$", "GBP": "£",
    "SEK": "kr ", "CAD": "C$", "NZD": "NZ$", "SGD": "S$", "ISK": "kr ", "KRW": "₩", "HKD": "HK$",
    "THB": "฿", "CNY": "CN¥", "TWD": "NT$", "VND": "₫", "IDR": "Rp ", "MYR": "RM ", "PHP": "₱",
    "INR": "₹", "COP": "$", "BRL": "R$", "MXN": "MX$", "CRC": "₡", "ZAR": "R ", "ETB": "Br ",
    "KES": "KSh ", "RWF": "FRw ", "AED": "AED ", "TRY": "₺", "CZK": "Kč ", "CHF": "CHF ",
    "PLN": "zł ", "HUF": "Ft ", "PEN": "S/ ", "GTQ": "Q", "SAR": "SR ", "ILS": "₪",
}

# --- fixed values: regions by country ---------------------------------------------------------------
REGION_COUNTRIES = {
    "eastAsia": ["JP", "KR", "TW", "CN", "HK", "MO", "MN"],
    "northAmerica": ["US", "CA"],
    "nordic": ["NO", "SE", "DK", "FI", "IS"],
    "uk": ["UK", "GB", "IE"],
    "oceania": ["AU", "NZ"],
    "seAsiaIndia": ["ID", "VN", "TH", "MY", "PH", "SG", "IN", "KH", "LA", "MM", "LK", "NP", "BD"],
    "latinAmerica": ["BR", "CO", "MX", "GT", "CR", "PE", "PA", "EC", "BO", "CL", "AR", "NI", "HN",
                     "SV", "DO", "JM", "UY"],
    "africaMideast": ["AE", "SA", "ZA", "ET", "KE", "RW", "IL", "QA", "KW", "BH", "OM", "JO", "EG",
                      "MA", "TZ", "UG", "BI", "MG"],
    "europe": ["DE", "FR", "ES", "IT", "NL", "BE", "AT", "PT", "PL", "CH", "CZ", "GR", "HU", "TR",
               "RO", "HR", "SI", "SK", "EE", "LV", "LT", "UA", "RS", "BG", "LU", "MT", "CY"],
}
DEFAULT_REGION = "europe"

# --- fixed values: point of a country [lon, lat] used when the city is unknown -----------------------
COUNTRY_POINTS = {
    "JP": (139.7, 35.68), "KR": (126.98, 37.57), "TW": (121.5, 25.0), "CN": (116.4, 39.9),
    "HK": (114.1, 22.3), "US": (-98, 39), "CA": (-106, 56), "NO": (10.75, 59.9),
    "SE": (18.07, 59.3), "DK": (12.57, 55.7), "FI": (24.94, 60.17), "IS": (-21.9, 64.1),
    "UK": (-1.5, 52.5), "GB": (-1.5, 52.5), "AU": (145, -37.8), "NZ": (174.8, -41.3),
    "ID": (106.8, -6.2), "VN": (106.7, 10.8), "TH": (100.5, 13.75), "MY": (101.7, 3.14),
    "PH": (121, 14.6), "SG": (103.8, 1.35), "IN": (77.2, 28.6), "BR": (-46.6, -23.5),
    "CO": (-74.1, 4.6), "MX": (-99.1, 19.4), "GT": (-90.5, 14.6), "CR": (-84.1, 9.9),
    "PE": (-77, -12), "AE": (55.3, 25.2), "SA": (46.7, 24.7), "ZA": (18.4, -33.9),
    "ET": (38.7, 9.0), "KE": (36.8, -1.3), "RW": (30.1, -1.9), "DE": (13.4, 52.52),
    "FR": (2.35, 48.86), "ES": (-3.7, 40.42), "IT": (12.5, 41.9), "NL": (4.9, 52.37),
    "BE": (4.35, 50.85), "AT": (16.37, 48.21), "PT": (-9.14, 38.72), "PL": (21.01, 52.23),
    "IE": (-6.26, 53.35), "CH": (7.45, 46.95), "CZ": (14.42, 50.09), "GR": (23.73, 37.98),
    "HU": (19.04, 47.5), "TR": (32.86, 39.93), "RO": (26.1, 44.43), "HR": (15.98, 45.81),
    "SI": (14.51, 46.06), "SK": (17.11, 48.15), "EE": (24.75, 59.44), "LV": (24.11, 56.95),
    "LT": (25.28, 54.69), "UA": (30.52, 50.45), "RS": (20.46, 44.79), "BG": (23.32, 42.7),
    "LU": (6.13, 49.61), "MT": (14.51, 35.9), "CY": (33.38, 35.19), "PA": (-79.52, 8.98),
    "EC": (-78.47, -0.18), "BO": (-68.15, -16.5), "CL": (-70.65, -33.45), "AR": (-58.38, -34.6),
    "NI": (-86.25, 12.13), "HN": (-87.19, 14.08), "SV": (-89.19, 13.69), "DO": (-69.93, 18.49),
    "JM": (-76.79, 17.97), "UY": (-56.16, -34.9), "IL": (34.78, 32.08), "QA": (51.53, 25.29),
    "KW": (47.98, 29.38), "BH": (50.59, 26.23), "OM": (58.41, 23.59), "JO": (35.93, 31.95),
    "EG": (31.24, 30.04), "MA": (-6.84, 33.97), "TZ": (39.28, -6.79), "UG": (32.58, 0.35),
    "BI": (29.36, -3.38), "MG": (47.52, -18.88), "KH": (104.92, 11.56), "LA": (102.6, 17.97),
    "MM": (96.16, 16.87), "LK": (79.86, 6.93), "NP": (85.32, 27.7), "BD": (90.41, 23.81),
    "MO": (113.54, 22.2), "MN": (106.92, 47.89),
}
DEFAULT_POINT = (0.0, 20.0)

# --- fixed values: names that are a country or state rather than a city -----------------------------
COUNTRY_NAMES = [
    "香港", "台湾", "インド", "フィリピン", "マレーシア", "タイ", "ベトナム", "インドネシア",
    "シンガポール", "中国", "韓国", "日本", "Arkansas", "Hong Kong", "India", "Philippines",
    "Malaysia", "Taiwan",
]

# --- fixed values: display names put back into English for a foreign shop's search -------------------
SEARCH_NAMES = {
    "エチオピア": "Ethiopia", "ケニア": "Kenya", "タンザニア": "Tanzania", "ルワンダ": "Rwanda",
    "ブルンジ": "Burundi", "ウガンダ": "Uganda", "マダガスカル": "Madagascar",
    "コロンビア": "Colombia", "ブラジル": "Brazil", "ペルー": "Peru", "ボリビア": "Bolivia",
    "エクアドル": "Ecuador", "パナマ": "Panama", "グアテマラ": "Guatemala",
    "コスタリカ": "Costa Rica", "ホンジュラス": "Honduras", "エルサルバドル": "El Salvador",
    "ニカラグア": "Nicaragua", "メキシコ": "Mexico", "インドネシア": "Indonesia",
    "ベトナム": "Vietnam", "インド": "India", "中国": "China", "台湾": "Taiwan", "タイ": "Thailand",
    "フィリピン": "Philippines", "ミャンマー": "Myanmar", "イエメン": "Yemen", "ブレンド": "Blend",
}

# --- fixed values: words dropped from a shop name before it is compared -----------------------------
SHOP_STOP_WORDS = (
    r"(?U)\b(coffee|roasters?|roastery|roasting|company|co|the|specialty|cafe|café|espresso|works"
    r"|stand|brewers?|kaffe|koffie)\b"
)

# --- fixed values: questions of the preference quiz (option label -> feature weights) ----------------
QUIZ = [
    [{"light": 2}, {"medium": 2}, {}],
    [{"light": 1, "africa": 1.5, "clean": 0.5}, {"africa": 0.8, "latam": 0.5, "natural": 1.2},
     {"latam": 1.5, "medium": 1}, {"geisha": 2, "experimental": 1}],
    [{"africa": 2}, {"latam": 2}, {"asia": 2}, {}],
    [{"clean": 1.5}, {"natural": 1.5}, {"experimental": 1.5, "geisha": 0.8}],
    [{}, {}],
    [{"budget": 2}, {}, {"budget": -1.5, "geisha": 0.5}],
]
