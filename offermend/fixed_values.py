"""Word lists, names, thresholds and texts that results must agree on.

Nothing here is logic. Every table is used as rows (literal arrays or a small DataFrame).
"""

from __future__ import annotations

# ---------------------------------------------------------------- attribute rules (fixed values)

# concept -> names the attribute goes by, first match per category wins
CONCEPT_NAMES = {
    "size": ["Marime:", "Méret:", "Размер:", "Size", "Rozmiar", "Größe", "Veľkosť", "Beden", "Tamanho"],
    "base_color": [
        "Culoare de baza", "Szín:", "Цвят:", "Color", "Case Color", "Strap Color", "Web Color", "Dial Color",
        "Kolor", "Farba", "Barva", "Colore", "Couleur", "Band Color", "Lens Color",
    ],
    "audience": ["Pentru:", "Gender", "Sex", "Płeć", "Nem", "Пол", "Cinsiyet", "Geschlecht", "Pohlaví", "Pohlavie"],
    "print": ["Imprimeu:", "Pattern", "Print", "Wzór", "Minta", "Шаблон"],
    "material": [
        "Material:", "Anyag:", "Материал:", "Material", "Materiał", "Materiál", "Strap Material", "Case Material",
        "Lining Material", "Materiale", "Matière", "Malzeme",
    ],
    "fit": ["Croiala:", "Fit", "Cut", "Fassung", "Krój", "Szabás"],
    "sleeve": ["Lungime maneca:", "Sleeve Length", "Sleeve", "Długość rękawa", "Ujjhossz"],
    "sport": ["Sport:", "Sport", "Activity", "Dyscyplina sportu", "Sportág"],
    "season": ["Sezon:", "Season", "Sezon", "Évszak", "Сезон"],
    "product_type": ["Tip produs:", "Product Type", "Ürün Tipi", "Typ produktu", "Terméktípus"],
    "care": [
        "Instructiuni ingrijire:", "Care Instructions", "Care Instructions (General)", "Instrucțiuni de îngrijire",
        "Pflegehinweise", "Instrukcje pielęgnacji",
    ],
    "closure_system": ["Sistem inchidere:", "Closure", "Fastening", "Band Style", "Zapięcie", "Zárás", "Застёжка"],
    "style": ["Stil:", "Style", "Styl", "Stílus", "Стиль"],
    "studs": ["Crampoane detasabile:"],
    "age": ["Varsta:", "Age Group", "Age", "Wiek", "Kor", "Возраст"],
    "closure_type": ["Tip inchidere:", "Closure Type", "Fastener Type", "Typ zapięcia"],
    "trouser_length": ["Tip:", "Type", "Typ", "Típus"],
}

# concepts whose rule value stands when the category lists no values for the attribute
FREEFORM_CONCEPTS = ("base_color", "material", "sport", "closure_system")
# concepts read from the title alone
TITLE_CONCEPTS = ("product_type",)

# concept -> ordered (words, value); any word present proposes the value
WORD_RULES = {
    "base_color": [
        (["negru", "black", "noir"], "Negru"),
        (["alb", "white", "blanc", "alb optic"], "Alb"),
        (["gri", "grey", "gray", "gris"], "Gri"),
        (["albastru", "blue", "navy", "bleumarin", "bleu"], "Albastru"),
        (["rosu", "red", "rouge"], "Rosu"),
        (["verde", "green", "vert"], "Verde"),
        (["portocaliu", "orange"], "Portocaliu"),
        (["galben", "yellow", "jaune"], "Galben"),
        (["roz", "pink", "rose", "roz arctic"], "Roz"),
        (["mov", "purple", "violet", "lila"], "Mov"),
        (["maro", "brown", "marron", "camel"], "Maro"),
        (["bej", "beige", "crem", "ivory"], "Bej"),
        (["argintiu", "silver", "argint"], "Argintiu"),
        (["auriu", "gold", "aur", "aurie"], "Auriu"),
    ],
    "material": [
        (["bumbac", "cotton", "100% bumbac", "100% cotton"], "Bumbac"),
        (["fleece", "french terry", "polar"], "Fleece"),
        (["poliester", "polyester", "dri-fit", "drifit", "dri fit", "climacool", "climalite"], "Poliester"),
        (["nailon", "nylon"], "Nailon"),
        (["piele", "leather", "cuir", "piele naturala"], "Piele"),
        (["lana", "wool", "merinos"], "Lana"),
        (["acril", "acrylic"], "Acril"),
        (["elastan", "elastane", "spandex", "lycra"], "Elastan"),
        (["mesh", "plasa"], "Mesh"),
        (["textil", "textile", "fabric"], "Textil"),
    ],
    "fit": [
        (["slim fit", "slim-fit", "fitted", "slim"], "Slim fit"),
        (["regular fit", "regular-fit", "standard"], "Regular fit"),
        (["lejer", "loose", "relaxed", "oversized", "wide"], "Lejer"),
        (["compresie", "compression", "tight"], "De compresie"),
    ],
    "sleeve": [
        (["fara maneca", "sleeveless", "maieu", "maiou", "tank", "vest"], "Fara maneca"),
        (["maneca lunga", "long sleeve", "long-sleeve"], "Maneca lunga"),
        (["maneca scurta", "short sleeve", "short-sleeve", "tricou", "t-shirt", "tee"], "Maneca scurta"),
        (["trei sferturi", "3/4", "three quarter"], "Maneca trei sferturi"),
    ],
    "sport": [
        (["fotbal", "football", "soccer"], "Fotbal"),
        (["baschet", "basketball", "jordan", "nba"], "Baschet"),
        (["alergare", "running", "run", "jogging", "marathon", "futócipő", "futás"], "Alergare"),
        (["fitness", "gym", "antrenament", "training", "workout", "crossfit"], "Fitness"),
        (["tenis", "tennis"], "Tenis"),
        (["golf"], "Golf"),
        (["natatie", "swimming", "swim"], "Natatie"),
        (["ciclism", "cycling", "bike", "bicycle"], "Ciclism"),
        (["ski", "schi", "snow", "snowboard"], "Ski"),
        (["volei", "volleyball"], "Volei"),
        (["rugby"], "Rugby"),
        (["handbal", "handball"], "Handbal"),
    ],
    "product_type": [
        (["hanorac", "hoodie", "sweatshirt"], "Hanorac"),
        (["bluza", "fleece", "track top"], "Bluza"),
        (["tricou", "t-shirt", "tee", "tshirt"], "Tricou"),
        (["geaca", "jacket", "parka", "anorak"], "Geaca"),
        (["jacheta"], "Jacheta"),
        (["pantalon", "jogger", "pant", "trouser"], "Pantaloni"),
        (["sort", "pantaloni scurti", "shorts"], "Pantaloni"),
        (["colanti", "legging", "tight"], "Colanti"),
        (["sapca", "cap", "hat", "bucket hat"], "Sapca"),
        (["caciula", "beanie", "boneta"], "Caciula"),
        (["sosete", "sock"], "Sosete"),
        (["minge", "ball"], "Minge"),
        (["rucsac", "backpack", "ghiozdan"], "Rucsacuri"),
        (["geanta", "bag", "borseta", "tote"], "Geanta"),
        (["manusi", "gloves", "glove"], "Manusi"),
    ],
    "closure_system": [
        (["velcro", "arici", "scratch"], "Velcro"),
        (["siret", "lace", "sireturi", "laces"], "Siret"),
        (["fermoar", "zip", "zipper"], "Fermoar"),
        (["slip-on", "slip on", "fara siret"], "Fara inchidere"),
        (["banda elastica", "elastic band"], "Banda elastica"),
        (["catarama", "buckle"], "Catarama"),
    ],
    "style": [
        (["high top", "high-top", "inalti"], "Profil inalt"),
        (["low", "low-top", "joasa"], "Profil jos"),
        (["mid", "mid-top", "mediu"], "Profil mediu"),
        (["snapback"], "Snapback"),
        (["baseball"], "Baseball"),
        (["bucket"], "Bucket"),
    ],
    "closure_type": [
        (["fermoar", "zip"], "Fermoar"),
        (["capse", "snap"], "Capse"),
        (["nasturi", "button"], "Nasturi"),
        (["arici", "velcro"], "Velcro"),
    ],
    "trouser_length": [
        (["scurti", "sort"], "Scurti"),
        (["trei sferturi", "3/4"], "Trei sferturi"),
        (["lungi", "long", "full"], "Lungi"),
    ],
}

# audience: ordered (words, accepted spellings tried in order, compared in lower case)
AUDIENCE_RULES = [
    (["baieti", "boys"], ["baieti", "boys", "boy"]),
    (["fete", "girls"], ["fete", "girls", "girl"]),
    (["copii", "kids", "junior", "jr", "children", "copil"], ["copii", "kids", "children", "junior", "unisex kids"]),
    (
        ["barbati", "men", "mens", "masculin", "barbat", "férfi"],
        ["barbati", "men", "male", "férfi", "férfiak", "herren", "mężczyźni"],
    ),
    (
        ["dama", "women", "femei", "feminin", "doamne", "lady", "női", "nők"],
        ["femei", "women", "female", "dama", "lady", "női", "nők", "damen", "kobiety"],
    ),
    (["unisex"], ["unisex"]),
]

# print: ordered (words, value, must the list hold exactly this value)
PRINT_RULES = [
    (["logo", "swoosh", "jumpman", "brand", "emblem"], "Logo", True),
    (["grafic", "graphic", "imprimeu", "pattern", "all over", "all-over"], "Cu model", False),
    (["uni color", "unicolor", "solid", "simplu", "plain"], "Uni", True),
]

# season: winter words, fleece unless a light word is present, then summer and light words
WINTER_WORDS = ["iarna", "winter", "thermal", "therma", "thermo", "warm", "caldura", "polar"]
LIGHT_WORDS = ["light", "usor", "lightweight", "breathable", "respirabil"]
SUMMER_WORDS = ["vara", "summer"]
WINTER_VALUE, SUMMER_VALUE = "Toamna-Iarna", "Primavara-Vara"

CARE_VALUES = ["Compatibil masina de spalat rufe", "Compatibil masina spalat rufe"]
STUDS_VALUE = "N/A"
AGE_PATTERNS = [r"\d+-\d+\s*ani", r"\d+\s*ani"]

# ---------------------------------------------------------------- colours (fixed values)

# palette family -> colour name proposed for the attribute
FAMILY_NAMES = {
    "black": "Negru", "white": "Alb", "gray": "Gri", "silver": "Gri", "red": "Rosu", "pink": "Roz",
    "orange": "Portocaliu", "yellow": "Galben", "green": "Verde", "blue": "Albastru", "navy": "Bleumarin",
    "purple": "Mov", "brown": "Maro", "beige": "Bej", "turquoise": "Turcoaz", "burgundy": "Visiniu",
    "khaki": "Kaki", "multicolor": "Multicolor", "other": "",
}

# palette family -> terms an accepted value may contain
FAMILY_TERMS = {
    "black": ["negru", "black", "noir", "черн", "fekete"],
    "white": ["alb", "white", "blanc", "бял", "fehér"],
    "gray": ["gri", "gray", "grey", "сив", "szürke"],
    "silver": ["argintiu", "silver", "gri", "ezüst", "сребрист"],
    "red": ["rosu", "roșu", "red", "rouge", "червен", "piros"],
    "pink": ["roz", "pink", "rose", "rosa", "розов", "rózsaszín"],
    "orange": ["portocaliu", "orange", "naranja", "оранжев", "narancssárga"],
    "yellow": ["galben", "yellow", "jaune", "жълт", "sárga"],
    "green": ["verde", "green", "vert", "зелен", "zöld"],
    "blue": ["albastru", "blue", "bleu", "azul", "син", "kék"],
    "navy": ["bleumarin", "navy", "marine", "темносин", "sötétkék"],
    "purple": ["mov", "lila", "purple", "violet", "лилав"],
    "brown": ["maro", "brown", "marron", "кафяв", "barna"],
    "beige": ["bej", "beige", "бежов", "bézs"],
    "turquoise": ["turcoaz", "turquoise", "türkiz", "тюркоаз"],
    "burgundy": ["visiniu", "bordo", "burgund", "burgundy", "бордо", "bordó"],
    "khaki": ["kaki", "khaki", "хаки"],
    "multicolor": ["multicolor", "multi", "több színű", "многоцветен"],
}

MULTICOLOR_NAMES = ["Multicolor", "Több színű", "Многоцветен", "Multi"]

# Colour words of each family, which have to equal the published table for equal results.
# More can be added as rows of ``cluster_table``.
COLOR_CLUSTERS = {
    "negru": ["negru", "black", "noir", "schwarz", "fekete", "czarny", "μαύρο", "mavro", "черен", "чёрный", "negra", "nero",
              "antracit", "anthracite", "charcoal", "carbune", "grafit", "jet black", "onyx"],
    "alb": ["alb", "white", "blanc", "weiss", "feher", "bialy", "λευκό", "lefko", "бял", "bianco", "blanco", "alb optic",
            "optical white", "off white", "off-white", "snow"],
    "gri": ["gri", "gray", "grey", "grau", "szurke", "szary", "γκρι", "gkri", "сив", "grigio", "gris", "melange", "melanj", "heather",
            "marl", "gri deschis", "gri inchis", "light gray", "dark gray", "light grey", "dark grey", "slate", "ash", "smoke"],
    "argintiu": ["argintiu", "silver", "ezust", "srebrny", "ασημί", "asimi", "сребрист", "argento", "plata", "metalic argintiu",
                 "metallic silver", "chrome"],
    "rosu": ["rosu", "roșu", "red", "rouge", "rot", "piros", "czerwony", "κόκκινο", "kokkino", "червен", "rosso", "rojo", "scarlet",
             "carmin", "carmine", "tomato", "rosu aprins", "bright red", "crimson"],
    "roz": ["roz", "pink", "rose", "rosa", "rozsaszin", "rozowy", "ροζ", "розов", "rosato", "roz pudrat", "dusty pink", "blush",
            "salmon", "somon", "hot pink", "fuchsia", "fuxia", "magenta"],
    "portocaliu": ["portocaliu", "orange", "narancssarga", "pomaranczowy", "πορτοκαλί", "portokali", "оранжев", "arancione", "coral",
                   "corai", "peach", "piersica", "terracota", "terra", "burnt orange"],
    "galben": ["galben", "yellow", "jaune", "gelb", "sarga", "zolty", "κίτρινο", "kitrino", "жълт", "giallo", "amarillo", "mustard",
               "mustar", "lime", "lemon", "lamaie", "neon yellow", "gold yellow"],
    "verde": ["verde", "green", "vert", "grun", "zold", "zielony", "πράσινο", "prasino", "зелен", "khaki", "kaki", "olive", "oliv",
              "masliniu", "forest green", "army green", "military", "militar", "lime green", "neon green", "sage", "mint green",
              "hunter green", "emerald", "smarald"],
    "albastru": ["albastru", "blue", "bleu", "blau", "kek", "niebieski", "μπλε", "mple", "син", "azzurro", "azul", "cobalt",
                 "cobalt blue", "electric blue", "royal blue", "albastru electric", "albastru royal", "denim", "powder blue",
                 "sky blue", "cerulean", "cornflower"],
    "bleumarin": ["bleumarin", "navy", "navy blue", "marine", "sotétkék", "granatowy", "ναυτικό", "темносин", "тъмносин", "blu navy",
                  "azul marino", "indigo", "midnight blue", "dark blue", "albastru inchis", "dark navy", "ink blue"],
    "mov": ["mov", "lila", "violet", "purple", "lilas", "liliowy", "λιλά", "лилав", "μωβ", "mwv", "bíbor", "viola", "liliac", "lavanda",
            "lavender", "mauve", "mouve", "orchid", "plum", "pruna", "amethyst", "ametist", "grape", "eggplant", "wisteria"],
    "maro": ["maro", "brown", "marron", "braun", "barna", "brazowy", "καφέ", "kafe", "кафяв", "marrone", "marrón", "chocolate",
             "ciocolata", "camel", "tan", "cognac", "coniac", "chestnut", "castan", "walnut", "nuc", "rust", "rugina", "cinnamon",
             "scortisoara", "hazel", "aluna"],
    "bej": ["bej", "beige", "bezs", "bezowy", "μπεζ", "mpez", "бежов", "cream", "crema", "ivory", "fildes", "lapte", "nude",
            "nude color", "sand", "nisip", "dune", "natural", "ecru", "linen", "in", "taupe", "stone", "piatra", "champagne", "sampanie"],
    "turcoaz": ["turcoaz", "turquoise", "turkiz", "turkusowy", "τιρκουάζ", "tirkoaz", "тюркоаз", "turchese", "teal", "aqua", "cyan",
                "mint", "menta", "aquamarine", "acvamarin", "sea green", "petrol", "duck blue", "albastru verzui"],
    "visiniu": ["visiniu", "burgundy", "bordo", "bordeaux", "burgund", "бордо", "bordó", "cherry", "cirese", "wine", "vin", "marsala",
                "oxblood", "claret", "deep red", "dark red", "rosu inchis", "merlot"],
    "auriu": ["auriu", "gold", "aur", "arany", "zloty", "χρυσό", "chryso", "злато", "oro", "dorado", "golden", "dourado",
              "champagne gold", "rose gold", "aur roz"],
    "multicolor": ["multicolor", "multi", "multi color", "több színű", "wielokolorowy", "πολύχρωμο", "многоцветен", "colorat",
                   "printed", "print", "pattern", "tipar", "tie dye", "tie-dye"],
}
AMBIGUOUS_CLUSTERS = ["mov", "turcoaz", "visiniu", "bej"]

# ---------------------------------------------------------------- thresholds (fixed values)

CATEGORY_CUTOFF, SUGGESTED_CATEGORY_CUTOFF, VALUE_CUTOFF = 0.90, 0.88, 0.80
AUTO_ACCEPT, SOFT_REVIEW, SOFT_ACCEPT = 0.82, 0.68, 0.70
RESOLVER_TIE, COLOR_TIE = 0.10, 0.08
SYNONYM_BONUS, SYNONYM_FLOOR = 0.15, 0.85
BATCH_SIZE = 60
REPAIR_BUDGET = 5
PRICE_IN, PRICE_OUT = 0.80 / 1_000_000, 4.00 / 1_000_000
ACTION_CONFIDENCE = {"ok": 0.95, "assigned": 0.75, "cat_assigned": 0.70, "ai_assigned": 0.70, "unknown": 0.0}

# ---------------------------------------------------------------- marketplaces (fixed values)

# name tokens -> language of the marketplace
LOCALES = {
    "emag_ro": "ro", "emag": "ro", "romania": "ro", "emag_hu": "hu", "hu": "hu", "hungary": "hu",
    "magyarország": "hu", "fashiondays_hu": "hu", "pepita": "hu", "emag_bg": "bg", "bg": "bg", "bulgaria": "bg",
    "fashiondays_bg": "bg", "allegro": "pl", "allegro_pl": "pl", "pl": "pl", "poland": "pl", "fashiondays": "ro",
    "trendyol": "tr", "decathlon": "ro", "temu": "ro", "temuro": "ro",
}

# ordered: aliases of a marketplace name, context text for requests
MARKETPLACE_CONTEXTS = [
    (
        ["bg", "bulg", "bulgaria", "bulgarian", "bgn", "българия", "emag bg", "fashiondays bg"],
        "eMAG България (Bulgaria). Valorile caracteristicilor trebuie sa fie in limba bulgara.",
    ),
    (
        ["hu", "hun", "hungary", "ungaria", "hungarian", "huf", "magyarország", "emag hu", "fashiondays hu"],
        "eMAG Magyarország (Ungaria). Valorile caracteristicilor trebuie sa fie in limba maghiara.",
    ),
    (
        ["pl", "pol", "polonia", "poland", "polish", "allegro", "pln"],
        "Allegro (Polonia). Categoriile si valorile sunt in poloneza.",
    ),
    (["fashiondays", "fashion days", "fashion-days"], "FashionDays."),
    (["trendyol"], "Trendyol."),
    (
        ["ro", "romania", "romanian", "ron", "emag"],
        "eMAG Romania. Valorile caracteristicilor trebuie sa fie in limba romana.",
    ),
]

# marketplace -> codes processed when nothing is saved for it
DEFAULT_ERROR_CODES = {
    "eMAG Romania": ["1007", "1009", "1010"],
    "Trendyol": ["3111"],
    "Allegro": [],
    "FashionDays": [],
}

BRAND_NAMES = ["brand", "marca", "marka", "márka", "marque", "марка"]

# ---------------------------------------------------------------- image rules (fixed values)

COLOR_ATTRIBUTES = [
    "Culoare de baza", "Culoare:", "Szín:", "Цвят:", "Color", "Case Color", "Strap Color", "Web Color", "Dial Color",
    "Band Color", "Lens Color", "Kolor", "Farba", "Barva", "Colore", "Couleur",
]
MIN_COLOR_CONFIDENCE, MULTICOLOR_THRESHOLD = 0.60, 0.80
CATEGORY_COLOR_CONFIDENCE = {"Smartwatches": 0.40, "Watches": 0.40}

# attribute -> (lowest image confidence, what a contradiction leads to)
IMAGE_POLICY = {name: (0.60, "prefer_text") for name in COLOR_ATTRIBUTES} | {
    "Imprimeu:": (0.70, "review"),
    "Lungime maneca:": (0.65, "prefer_text"),
    "Tip produs:": (0.75, "prefer_text"),
    "Stil:": (0.70, "review"),
    "Sistem inchidere:": (0.75, "prefer_text"),
    "Tip inchidere:": (0.75, "prefer_text"),
    "Pentru:": (0.80, "prefer_text"),
}

DETECTION_LABELS = [
    "person", "backpack", "handbag", "suitcase", "tie", "umbrella", "chair", "couch", "bed", "dining table",
    "potted plant", "clock", "vase", "teddy bear", "cell phone", "laptop", "keyboard", "tv", "remote", "bottle",
    "cup", "bowl", "book", "scissors", "toothbrush", "hair drier",
]
CLIP_LABELS = [
    "t-shirt", "hoodie", "jacket", "pants", "shorts", "shoes", "sneakers", "dress", "shirt", "coat", "bag",
    "backpack", "hat", "cap", "socks", "sportswear", "running shoes", "football", "basketball",
]

VISION_COUNTERS = [
    "total_images", "fetch_ok", "fetch_fail", "fetch_cache_hit", "yolo_ok", "yolo_fallback", "clip_ok",
    "clip_fallback", "color_ok", "fills", "needs_review", "skipped",
]

# ---------------------------------------------------------------- input headers (fixed values)

CATEGORY_ALIASES = {
    "id": ["id", "category_id", "cat_id", "id_categorie"],
    "external_id": ["emag_id", "marketplace_id", "external_id", "id_extern"],
    "name": ["name", "name_ro", "nume", "denumire", "category_name"],
    "parent_id": ["parent_id", "parent", "id_parinte"],
}
CHARACTERISTIC_ALIASES = {
    "id": ["id", "char_id", "id_caracteristica"],
    "characteristic_id": ["characteristic_id", "emag_characteristic_id", "char_emag_id"],
    "category_id": ["category_id", "cat_id", "id_categorie"],
    "name": ["name", "name_ro", "nume", "characteristic_name", "denumire"],
    "mandatory": ["mandatory", "obligatoriu", "required", "is_mandatory"],
    "restrictive": ["restrictive", "is_restrictive", "restrictiv"],
}
VALUE_ALIASES = {
    "category_id": ["category_id", "cat_id"],
    "characteristic_id": ["characteristic_id", "char_id", "emag_characteristic_id"],
    "characteristic_name": ["characteristic_name", "name", "char_name", "name_ro", "denumire"],
    "value": ["label", "value", "value_ro", "valoare", "val", "val_ro"],
}
OFFER_ALIASES = {
    "offer_id": ["id intern ofertă", "id intern oferta", "id", "offer_id", "id_oferta"],
    "title": ["nume", "name", "title", "titlu", "product_name"],
    "status": ["status"],
    "error": ["eroare ofertă", "eroare oferta", "error", "eroare", "offer_errors", "offer_error"],
    "description": ["descriere", "description", "desc"],
    "category": ["categorie", "category", "cat", "category_name"],
    "image_url": [
        "image url", "image_url", "url imagine", "url_imagine", "img_url", "photo_url", "imagine", "imagini",
        "image", "poza", "foto", "image src", "image_src",
    ],
    "ean": ["ean", "barcode", "cod bare", "gtin", "isbn", "upc"],
    "brand": ["brand", "marca", "marcă", "brand_name"],
    "sku": ["sku", "part_number", "part number", "cod produs", "cod_produs", "model"],
    "weight": ["weight", "greutate", "weight_kg", "greutate_kg"],
    "warranty": ["warranty", "garantie", "garanție", "garantie_luni", "warranty_months"],
}

# ---------------------------------------------------------------- result texts (fixed values)

NO_VALUES_REASON = "Fără valori permise definite pentru această categorie"
MODEL_MISS_REASON = "Detectie automată și AI nu au găsit o valoare validă în titlu/descriere"
RULE_MISS_REASON = "Keywords nedetectate în titlu/descriere (AI dezactivat)"
CATEGORY_TIMEOUT_REASON = (
    "AI timeout — modelul nu a raspuns la timp. Mareste OLLAMA_TIMEOUT in .env sau foloseste un model mai rapid."
)
CATEGORY_UNKNOWN_REASON = ("AI a sugerat '", "' dar nu există în lista marketplace-ului")
CATEGORY_NULL_REASON = "AI a returnat null — categoria nu a putut fi determinată din titlu"
CATEGORY_OFF_REASON = "AI dezactivat — categoria nu a putut fi determinată automat"
TIMEOUT_MARK = "__timeout__"
NO_CATEGORY_LABEL = "(fara categorie)"
