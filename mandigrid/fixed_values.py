"""Spelling tables, name patterns, marker words and defaults.

These are data, not logic. They are listed in their natural order because the
pattern tables are applied one after the other.
"""

# --- Fixed values: commodity spellings, whole-name replacement -------------
COMMODITY_CORRECTIONS = {
    "Pine Apple": "Pineapple",
    "Soanf": "Saunf",
    "Amaranthus": "Amaranth",
    "Lilly": "Lily",
    "Amphophalus": "Amorphophallus",
    "Cornation": "Carnation",
    "Colacasia": "Colocasia",
    "Maragensu": "Maragenasu",
    "Mashroom": "Mushroom",
    "Borehannu": "Bore Hannu",
    "Rajgir": "Rajgira",
    "Cane": "Sugarcane",
    "Suram": "Suran",
    "Cinamon": "Cinnamon",
    "Mataki": "Matki",
    "Kankambra": "Kanakambara",
    "Pears": "Pear",
    "Ajwan": "Ajwain",
    "Cardamoms": "Cardamom",
    "Lentil(Masur)": "Lentil(Masoor)",
    "Antawala": "Antwala",
    "Cucumbar": "Cucumber",
    "Astera": "Aster",
    "Gur(Jaggery)": "Jaggery",
    "Pigs": "Pig",
    "BOP": "Bird of Paradise",
    "Jowar(Sorgham)": "Sorghum",
    "Soyabean": "Soybean",
    "Paddy(Dhan)": "Paddy",
    "Bajra(Pearl Millet)": "Pearl Millet",
    "Barley (Jau)": "Barley",
    "Ragi (Finger Millet)": "Finger Millet",
    "Green Chilly": "Green Chilli",
    "Bhindi(Ladies Finger)": "Ladies Fingers",
}

# --- Fixed values: translated commodity names, whole-name replacement ------
COMMODITY_TRANSLATIONS = {
    "Jack Fruit": "Jackfruit",
    "Mousambi": "Sweet Lemon",
    "Isabgul (Psyllium)": "Psyllium",
    "Sesamum(Sesame,Gingelly,Til)": "Sesame",
    "Gingelly Oil": "Sesame Oil",
    "Arecanut(Betelnut/Supari)": "Areca Nut",
    "Soanf": "Fennel",
    "Brinjal": "Eggplant",
    "Torchwood": "Sea Torchwood",
    "Karbuja": "Muskmelon",
    "Amorphophallus": "Elephant Foot Yam",
    "Thondekai": "Ivy Gourd",
    "Myrobalan": "Yellow Myrobalan",
    "Mahua": "Madhuca Longifolia",
    "Karamani": "Cow Pea",
    "Marasebu": "Pear",
    "Jau": "Barley",
    "Seemebadnekai": "Chayote Squash",
    "Colacasia": "Taro",
    "Gurellu": "Niger Seed",
    "Maragenasu": "Cassava",
    "Bore Hannu": "Jujube",
    "Rajgira": "Amaranth",
    "Marygold(Loose)": "Marigold",
    "Methi": "Fenugreek",
    "Chakotha": "Grapefruit",
    "Siddota": "Muskmelon",
    "Balekai": "Plantain",
    "Anjura": "Fig",
    "Toria": "Canola",
    "Raya": "Indian Mustard",
    "Suran": "Elephant Foot Yam",
    "Kakada": "Indian Jasmine",
    "Antawala": "Soapnut",
    "Kacholam": "Aromatic Ginger",
    "Anthorium": "Anthurium",
    "Galgal(Lemon)": "Hill Lemon",
    "Marget": "Passion Flower Lady Margaret",
    "Matki": "Moth Bean",
    "Sajje": "Pearl Millet",
    "Tinda": "Indian Round Gourd",
    "Varagu": "Kodo Millet",
    "Antwala": "Soapnut",
    "Ridgeguard(Tori)": "Turai",
    "Turai": "Ridge Gourd",
    "Taramira": "Jamba",
    "Dhaincha": "Sesbania Cannabina",
    "Aster": "Indian Aster",
    "Chikoos(Sapota)": "Sapodilla",
    "Kanakambara": "Firecracker Flower",
    "Bengal Grams(Gram)": "Chickpea",
    "Black Grams (Urd Beans)": "Black Gram",
    "Arhar (Tur)": "Pidgeon Pea",
    "Red Grams": "Pidgeon Pea",
    "Green Grams(Moong)": "Mung Bean",
    "Green Gram(Dal)": "Green Dal",
    "Peas(Dry)": "Dried Peas",
}

# --- Fixed values: state spellings, whole-name replacement -----------------
STATE_CORRECTIONS = {
    "Orissa": "Odisha",
    "Chattisgarh": "Chhattisgarh",
    "Uttrakhand": "Uttarakhand",
}

# --- Fixed values: market-name patterns for bulletin rows, in order --------
# Parentheses are literal here.
BULLETIN_MARKET_PATTERNS = {
    r"Mkt.": "",
    r"Market": "",
    r"Yard": "",
    r",RBZ": "",
    r"\(AP\)": "",
    r"\(UP\)": "",
    r"\(BH\)": "",
    r"\(KA\)": "",
    r" Hqs": "",
    r"\(main\)": "",
    r"\s+": " ",
    r" ,$": "",
    r"V.Kota": "Venkatagirikota",
    r"Fish,Poultry & Egg , Gazipur": "Fish and Poultry Market, Gazipur",
    r"Udaipur\(F&V\)": "Vegetable Market, Udaipur",
}

# --- Fixed values: market-name patterns for market profiles, in order ------
PROFILE_MARKET_PATTERNS = {
    r"Mkt.": " Market ",
    r"Market": "",
    r"Yard": "",
    r",RBZ": "",
    r"\(AP\)": "",
    r"\(UP\)": "",
    r"\(BH\)": "",
    r"\(KA\)": "",
    r" Hqs": "",
    r"\(main\)": "",
    r"V.Kota": "Venkatagirikota",
    r"Fish,Poultry & Egg , Gazipur": "Poultry Market, Gazipur",
    r"Udaipur\(F&V\)": "Vegetable Market, Udaipur",
}

# --- Fixed values: lookup-key aliases, any key containing the first part ---
MARKET_KEY_ALIASES = {"Dimapur": "Nagaland_Dimapur"}

# --- Fixed values: address spellings by state, literal text, in order ------
ADDRESS_CORRECTIONS = {
    "Andhra Pradesh": {
        "W Godavary": "West Godavari",
        "Ananthapuramu": "Ananthapur",
        "Anantapuramu": "Ananthapur",
        "Anatapuramu": "Ananthapur",
        "Y S R Kadapa": "Cuddapah",
        "Visakha ": "Visakhaptnam ",
    },
    "Bihar": {
        "E Champaran": "East Champaran",
        "Purnea": "Purnia",
    },
    "Uttar Pradesh": {
        "Badaun": "Budaun",
        "Divai": "Dibai",
        "Dist Bali": "Dist Ballia",
        "Choubepur Kanpur": "Chaubepur Kanpur Nagar",
        "Rura , Dist Kanpur": "Rura, Dist Kanpur Dehat",
        "Kanpur City": "Kanpur Nagar",
        "Bullandshar": "Bulandshahr",
    },
    "Punjab": {
        "Nawan Shahar": "Nawanshahr",
        "Nawanshar": "Nawanshahr",
        "Nawanshahar": "Nawanshahr",
    },
    "Gujarat": {
        "Junagarh": "Junagadh",
    },
}

# --- Fixed values: words an address is read by -----------------------------
DISTRICT_MARKERS, DISTRICT_REACH = ["dist", "dt"], 2
TALUK_MARKERS, TALUK_REACH = ["mdl", "mandal", "tehsil", "taluk"], 1
DISTRICT_WORD_SPELLINGS = {r"(?i)Disst": "Dist", r"(?i)Dis ": "Dist "}
TALUK_STOPWORDS = [
    "Dist", "Distt", "Dt", "Mandi", "Road", "Yard", "Secretary", "Committee",
    "Agricultural", "Konya",
]
NOT_A_DISTRICT_WORD = ["Khada"]
MANDI_LOOKALIKES = ["Bundi", "Banda", "Gonda"]
TALUK_FALSE_SUFFIXES = [" Road", " Raj"]
MARKET_TALUK_ALIASES = {"Doranpal": "Dornapal"}

# --- Fixed values: census place-name patterns, in order --------------------
CENSUS_NAME_PATTERNS = {
    r"Medinipur": "Midnapore",
    r"Purba ": "East ",
    r"Purbi ": "East ",
    r"Paschim ": "West ",
    r"Pashchim ": "West ",
    r"Pashchimi ": "West ",
    r"Uttar ": "North ",
    r"^Dakshin ": "South ",
    r"Sahibzada Ajit Singh Nagar": "Mohali",
    r"Y\.S\.R\.": "Y.S.R. Cuddapah",
    r"Subarnapur": "Sonapur",
    r"South Twenty Four Parganas": "South 24 Parganas",
    r"North Twenty Four Parganas": "North 24 Parganas",
    r"Hugli": "Hooghly",
    r"^Garhwal$": "Pauri Garhwal",
    r"Mahamaya Nagar": "Hathras",
    r"Thoothukkudi": "Tuticorin",
    r"North Pradesh": "Uttar Pradesh",
    r"Rangareddy": "K.V.Rangareddy",
    r"\s+": " ",
    r"Bangalore$": "Bangalore Urban",
}

# --- Fixed values: census measures (report heading -> our column) ----------
CENSUS_MEASURES = {
    "Total Population Person": "total",
    "Total Worker Population Person": "work",
    "Main Cultivator Population Person": "cultivator_main",
    "Marginal Cultivator Population Person": "cultivator_marginal",
    "Main Agricultural Labourers Population Person": "agrilabourers_main",
    "Marginal Agriculture Labourers Population Person": "agrilabourers_marginal",
    "Non Working Population Person": "no_work",
}

# --- Fixed values: postal-directory patterns, in order ---------------------
POSTAL_STATE_PATTERNS = {r"&": "and", r"Delhi$": "NCT of Delhi"}
POSTAL_DISTRICT_PATTERNS = {
    r"&": "and",
    r"\((KAR|HP|MH|CGH|BH)\)": "",
    r"Bangalore$": "Bangalore Urban",
}
POSTAL_TALUK_PATTERNS = {
    r"\.\.": ".",
    r"\s+": " ",
    r"(?i)(Mandall|Mandalam|\(mdl\)|Mandal)": "",
}

# --- Fixed values: boundary-name patterns, in order ------------------------
BOUNDARY_DISTRICT_PATTERNS = {
    r"^Ladakh \(Leh\)$": "Leh",
    r"\(.*\)": "",
    r"(\w+) Imphal": "Imphal $1",
    r"Pashchim": "West",
    r"Dakshin": "South",
    r"Uttar ": "North ",
    r"Purba": "East",
    r"South Kannad": "Daskhina Kannada",
    r"North Kannand": "Uttar Kannada",
    r"Greater Bombay": "Mumbai",
    r"Kavaratti": "Lakshadweep",
    r"Thoothukudi": "Tutocorin",
    r"Nawan Shehar": "Nawanshahr",
    r"Bagdam": "Bugdam",
    r"Kawardha": "Kabirdham",
}
BOUNDARY_WEST_BENGAL_PATTERNS = {
    r"Hugli": "Hooghly",
    r"Kochbihar": "Cooch Behar",
    r"Haora": "Howrah",
}
BOUNDARY_SKIPPED = ["Junagadh"]
BOUNDARY_SPLIT = {"Andaman Islands": ["North and Middle Andaman", "South Andaman"]}
BOUNDARY_STATE_ALIASES = {"Delhi": "NCT of Delhi"}

# --- Fixed values: city names and summary rows of city price tables --------
CITY_ALIASES = {"T.PURAM": "Thiruvananthapuram"}
CITY_SUMMARY_ROWS = r"(Maximum|Minimum|Modal) Price"

# --- Fixed values: markers that stand for "missing" ------------------------
MISSING_MARKERS = ["", "*", "NR", "NA", "-", "n.a."]
NOT_REPORTED = "NR"

# --- Fixed values: headings that recur inside stacked reports --------------
REPORT_HEADINGS = [
    "commodity", "year", "month", "state", "district", "market",
    "commodityTonnage", "records", "coverage",
]

# --- Fixed values: defaults of the quality map -----------------------------
DEFAULT_THRESHOLDS = {"missing_prices": 100, "missing_tonnages": 100, "coverage": 0}
COUNTRY = "India"
CENTURY_PIVOT = 59
OUTLIER_PRICE = 100
AXIS_YEARS = (2002, 2015)
