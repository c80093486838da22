"""Fixed values the results depend on: codes, names, bands, labels and formats.

Everything here is data that has to equal the listing site's own vocabulary. No logic lives in this module.
"""

# --- fixed values: listing types, in retrieval order (id, English name, Japanese name) ---
LISTING_TYPES = [
    ("040", "Rental", "賃貸"),
    ("030", "Land", "土地"),
    ("021", "Second-hand house", "中古一戸建て"),
    ("020", "New house", "新築一戸建て"),
    ("011", "Second-hand mansion", "中古マンション"),
    ("010", "New mansion", "新築マンション"),
]
RENTAL_TYPE = "040"
NEW_APARTMENT_TYPE = "010"
UNIT_TYPES = ["011", "010"]

# --- fixed values: regions (id, name, first prefecture code, prefecture names in JIS order) ---
REGIONS = [
    ("010", "Hokkaido", 1, ["Hokkaido"]),
    ("020", "Tohoku", 2, ["Aomori", "Iwate", "Miyagi", "Akita", "Yamagata", "Fukushima"]),
    ("030", "Kanto", 8, ["Ibaraki", "Tochigi", "Gunma", "Saitama", "Chiba", "Tokyo", "Kanagawa"]),
    ("040", "Hokuriku", 15, ["Niigata", "Toyama", "Ishikawa", "Fukui", "Yamanashi", "Nagano"]),
    ("050", "Tokai", 21, ["Gifu", "Shizuoka", "Aichi", "Mie"]),
    ("060", "Kansai", 25, ["Shiga", "Kyoto", "Osaka", "Hyogo", "Nara", "Wakayama"]),
    ("080", "Chugoku", 31, ["Tottori", "Shimane", "Okayama", "Hiroshima", "Yamaguchi"]),
    ("070", "Shikoku", 36, ["Tokushima", "Kagawa", "Ehime", "Kochi"]),
    ("090", "Kyushu", 40, ["Fukuoka", "Saga", "Nagasaki", "Kumamoto", "Oita", "Miyazaki", "Kagoshima", "Okinawa"]),
]

# --- fixed values: prefectures as written in addresses; position + 1 is the JIS code ---
PREFECTURES_JA = [
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都",
    "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府",
    "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県",
    "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
]

# --- fixed values: crawl plan ---
PAGE_SIZES = {"rental": 50, "sale": 100}
CAUGHT_UP_PAGES = 2
# URL of one list page per search; {site} is the listing site's origin, which the caller supplies.
PAGE_URLS = {
    "sale": "{site}/jj/bukken/ichiran/JJ012FC001/?ar={area}&bs={type}&ta={province}&pn={page}&ekTjCd=&ekTjNm=&kb=1"
            "&kj=9&km=1&kt=9999999&tb=0&tj=0&tt=9999999&po=1&pj=2&pc=100",
    "new_apartment": "{site}/jj/bukken/ichiran/JJ011FC001/?ar={area}&bs={type}&ta={province}&po=1&pj=2&popj=12&pc=100"
                     "&page={page}",
    "rental": "{site}/jj/chintai/ichiran/FR301FC001/?ar={area}&bs={type}&ta={province}&page={page}&pc=50&po1=09&cb=0.0"
              "&ct=9999999&et=9999999&cn=9999999&mb=0&mt=9999999&shkr1=03&shkr2=03&shkr3=03&shkr4=03&fw2="
              "&srch_navi=1",
}
RENTAL_URL_MARKS = ["/jj/chintai/ichiran/", "bs=040"]
RESIZE_PATH = "/jj/resizeImage"
PHOTO_SIZE = (1024, 768)

# --- fixed values: listing filters; sale price bands are [min, max), size is a minimum, walk a maximum ---
PRICE_BANDS = {
    "any": (None, None),
    "under30": (None, 30_000_000),
    "30to60": (30_000_000, 60_000_000),
    "60to100": (60_000_000, 100_000_000),
    "over100": (100_000_000, None),
}
SIZE_MINIMUMS = {"any": 0, "40": 40, "60": 60, "80": 80}
WALK_MAXIMUMS = {"any": 0, "5": 5, "10": 10, "15": 15}
LISTINGS_PER_PAGE = 12
BUILDINGS_PER_PAGE = 10
UNITS_PER_BUILDING = 20
PROPOSALS_PER_PAGE = 50
TEXTS_PER_REQUEST = 50

# --- fixed values: monthly rent bands (min, max), both ends inclusive ---
RENT_BANDS = [
    (0, 50_000, "Under ¥50,000"),
    (50_000, 75_000, "¥50,000 – ¥75,000"),
    (75_000, 100_000, "¥75,000 – ¥100,000"),
    (100_000, 150_000, "¥100,000 – ¥150,000"),
    (150_000, 200_000, "¥150,000 – ¥200,000"),
    (200_000, 300_000, "¥200,000 – ¥300,000"),
    (300_000, None, "Over ¥300,000"),
]

# --- fixed values: listing-count thresholds of the map legend ---
COUNT_THRESHOLDS = [50, 150, 400, 1000, 2500]

# --- fixed values: building keys ---
BUILDING_KEY_PREFIX = "building-"

# --- fixed values: transit kinds and match thresholds ---
TRANSIT_KINDS = ["rail", "subway", "tram", "monorail", "shinkansen", "bus", "unknown"]
STRONG_MATCH = 0.55
CANDIDATES_FOR_DECISION = 15
CANDIDATES_DEFAULT = 20
CONTAINED_IN_TARGET = 0.85
CONTAINS_TARGET = 0.80
REGION_BOOST = 0.05

# --- fixed values: patterns that mark a transit label as a bus route or stop ---
BUS_PATTERNS = [
    r"(バス|系統|方面|経由|循環|ライナー(?!.*線))",
    r"(行き?|停|乗場|のりば)",
    r"[〔［\[【]",
]
BUS_ROUTE_CODE = r"^\p{IsHan}{0,2}\d{1,3}([-.・]\d{1,3})?$"
BUS_EMBEDDED_CODE = r"\p{IsHan}\d{2}"
BUS_CODE_SEPARATOR = r"[・,、]"

# --- fixed values: name normalisation, applied in this order after NFKC ---
NAME_CUTS = [
    r"[〔［\[(（【].*?[〕］\])）】]",
    r"[/／:：~～].*$",
    r"駅.*$",
    r"(方面|行き?|経由|停).*$",
    r"\s+",
]

# --- fixed values: labels of a sale card ---
LABEL_PRICE = "販売価格"
LABEL_LAND_AREA = "土地面積"
LABEL_ADDRESS = "所在地"
LABEL_STATION = "沿線・駅"
LABEL_COVERAGE = "建ぺい率・容積率"
LABEL_NAME = "物件名"
LABEL_TSUBO = "坪単価"
LABEL_PHOTOS = "掲載写真"
LABEL_BUILDING_AREA = "建物面積"
LABEL_UNIT_AREA = "専有面積"
LABEL_LAYOUT = "間取り"
LABEL_ACCESS = "交通"
TYPED_LABELS = [
    LABEL_PRICE, LABEL_LAND_AREA, LABEL_ADDRESS, LABEL_STATION, LABEL_COVERAGE, LABEL_NAME, LABEL_TSUBO,
    LABEL_PHOTOS, LABEL_BUILDING_AREA, LABEL_UNIT_AREA, LABEL_LAYOUT,
]
MOVIE_ICON = "move_92_69.png"

# --- fixed values: detail-page labels already shown as typed columns ---
TYPED_DETAIL_LABELS = ["価格", "間取り", "土地面積", "建物面積", "完成時期（築年月）", "住所", "交通"]
DETAIL_LABEL_CLASSES = ["thSideLGray", "overview_table-title", "detailtable-title"]

# --- fixed values: refresh policy and run statuses ---
DETAIL_MAX_AGE_SECONDS = 7 * 24 * 3600
FAILED_RETRY_SECONDS = 3600
RUN_STATUSES = ["idle", "queued", "running", "completed", "failed", "cancelled"]
STOP_REASONS = ["completed", "caught-up", "no-items", "timed-out", "cancelled", "failed"]
