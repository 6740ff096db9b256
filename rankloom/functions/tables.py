"""Code lists of the domain, each as a dictionary or list in its natural order. Users can pass their own."""

from __future__ import annotations

#: Quota aliases, by code.
QUOTA = {
    "AIQ": ["AIQ", "AI", "A.I.", "A.I.Q.", "ALL INDIA", "ALL INDIA QUOTA"],
    "AMU": ["AMU", "A.M.U.", "AM", "ALIGARH MUSLIM UNIVERSITY", "ALIGARH MUSLIM UNIVERSITY QUOTA"],
    "BHU": ["BHU", "B.H.U.", "BH", "BANARAS HINDU UNIVERSITY", "BANARAS HINDU UNIVERSITY QUOTA"],
    "DU": ["DU", "D.U.", "DELHI UNIVERSITY", "DELHI UNIVERSITY QUOTA"],
    "IP": ["IP", "I.P.", "IPCL", "IP UNIVERSITY", "IP UNIVERSITY QUOTA", "INDRAPRASTHA UNIVERSITY"],
    "JM": ["JM", "J.M.", "JAMIA", "JAMIA MILLIA ISLAMIA", "JAMIA MILLIA ISLAMIA QUOTA"],
    "MM": ["MM", "M.M.", "MUSLIM MINORITY", "MUSLIM MINORITY QUOTA"],
    "AFMS": ["AFMS", "AF", "A.F.", "A.F.M.S.", "ARMED FORCES", "ARMED FORCES MEDICAL", "ARMED FORCES MEDICAL SERVICES"],
    "AFMS-DNB": ["AFMS-DNB", "AFMSDNB"],
    "DNB": ["DNB POST MBBS", "DNB-POST MBBS", "AD", "DNB", "DNB QUOTA"],
    "MNG": ["MNG", "MANAGEMENT", "MGT", "PS", "MANAGEMENT QUOTA", "MANAGEMENT/PAID SEATS QUOTA", "MANAGEMENT/PAID SEATS", "PAID SEATS QUOTA"],
    "NBE Diploma": ["NBE DIPLOMA", "NBE-DIPLOMA", "DIPLOMA"],
    "NRI": ["NRI", "N.R.I.", "NR", "NRI QUOTA", "NON-RESIDENT INDIAN", "NON- RESIDENT INDIAN", "NON RESIDENT INDIAN", "NON RESIDENT INDIANS"],
    "SFS": [
        "SFS", "SELF FINANCED", "SELF-FINANCED", "SELF FINANCED MERIT SEAT", "SELF-FINANCED MERIT SEAT", "SELF FINANCED SEAT", "SELF-FINANCED SEAT",
        "SELF-FINANCED MERIT SEAT/(PAID SEAT QUOTA)", "SELF FINANCED MERIT SEAT/(PAID SEAT QUOTA)", "SELF-FINANCED SEAT/(PAID SEAT QUOTA)", "SELF FINANCED SEAT/(PAID SEAT QUOTA)",
    ],
    "JN": ["JAIN MINORITY", "JAIN MINORITY QUOTA", "JAIN"],
}

#: Category aliases in upper case, by code.
CATEGORY = {
    "GEN": ["GEN", "GENERAL", "UR", "UNRESERVED", "GN", "OPEN"],
    "EWS": ["EWS", "EW", "E.W.S."],
    "OBC": ["OBC", "OBC-NCL", "OBCNCL", "BC", "SEBC"],
    "SC": ["SC"],
    "ST": ["ST"],
    "GEN-PwD": ["GEN-PWD", "GEN-PH", "UR-PWD", "UR-PH", "OPEN PWD", "OPEN PH", "OPEN-PWD"],
    "EWS-PwD": ["EWS-PWD", "EWS-PH", "EWS PWD", "EWS PH"],
    "OBC-PwD": ["OBC-PWD", "OBC-PH", "OBC PWD", "OBC PH"],
    "SC-PwD": ["SC-PWD", "SC-PH", "SC PWD", "SC PH"],
    "ST-PwD": ["ST-PWD", "ST-PH", "ST PWD", "ST PH"],
    "AFMS-Priority III": ["AFMS-PRIORITY III", "AFMS-PRIORITY-III", "AFMS-P3", "AFMS P3", "AFMS PRIORITY III"],
    "AFMS-Priority IV": ["AFMS-PRIORITY IV", "AFMS-PRIORITY-IV", "AFMS-P4", "AFMS P4", "AFMS PRIORITY IV"],
}

#: Names of states as they occur in addresses.
STATES = [
    "Andaman and Nicobar Islands", "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chandigarh", "Chhattisgarh",
    "Dadra and Nagar Haveli and Daman and Diu", "Dadra and Nagar Haveli", "Daman and Diu", "Delhi", "New Delhi", "Goa", "Gujarat", "Haryana",
    "Himachal Pradesh", "Jammu and Kashmir", "Jammu & Kashmir", "Jharkhand", "Karnataka", "Kerala", "Ladakh", "Lakshadweep", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Orissa", "Puducherry", "Pondicherry", "Punjab", "Rajasthan", "Sikkim",
    "Tamil Nadu", "Tamilnadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "Uttaranchal", "West Bengal",
]

#: Older or shorter names of states.
STATE_NOW = {
    "New Delhi": "Delhi",
    "Jammu & Kashmir": "Jammu and Kashmir",
    "Uttaranchal": "Uttarakhand",
    "Orissa": "Odisha",
    "Tamilnadu": "Tamil Nadu",
    "Pondicherry": "Puducherry",
    "Daman and Diu": "Dadra and Nagar Haveli and Daman and Diu",
    "Dadra and Nagar Haveli": "Dadra and Nagar Haveli and Daman and Diu",
}

#: Beginnings of postal codes, by state; a longer one goes before a shorter.
PIN_PREFIX = {
    "11": "Delhi", "110": "Delhi",
    "12": "Haryana", "13": "Haryana",
    "14": "Punjab", "15": "Punjab", "16": "Punjab",
    "17": "Himachal Pradesh",
    "18": "Jammu and Kashmir", "19": "Jammu and Kashmir",
    "20": "Uttar Pradesh", "21": "Uttar Pradesh", "22": "Uttar Pradesh", "23": "Uttar Pradesh", "24": "Uttar Pradesh", "25": "Uttar Pradesh", "26": "Uttar Pradesh", "27": "Uttar Pradesh", "28": "Uttar Pradesh",
    "30": "Rajasthan", "31": "Rajasthan", "32": "Rajasthan", "33": "Rajasthan", "34": "Rajasthan",
    "36": "Gujarat", "37": "Gujarat", "38": "Gujarat", "39": "Gujarat",
    "40": "Maharashtra", "41": "Maharashtra", "42": "Maharashtra", "43": "Maharashtra", "44": "Maharashtra",
    "45": "Madhya Pradesh", "46": "Madhya Pradesh", "47": "Madhya Pradesh", "48": "Madhya Pradesh",
    "49": "Chhattisgarh",
    "50": "Telangana", "51": "Telangana", "52": "Telangana",
    "53": "Andhra Pradesh",
    "56": "Karnataka", "57": "Karnataka", "58": "Karnataka", "59": "Karnataka",
    "60": "Tamil Nadu", "61": "Tamil Nadu", "62": "Tamil Nadu", "63": "Tamil Nadu", "64": "Tamil Nadu",
    "67": "Kerala", "68": "Kerala", "69": "Kerala",
    "70": "West Bengal", "71": "West Bengal", "72": "West Bengal", "73": "West Bengal", "74": "West Bengal",
    "75": "Odisha", "76": "Odisha", "77": "Odisha",
    "78": "Assam", "79": "Assam",
    "80": "Bihar", "81": "Bihar", "82": "Bihar", "83": "Bihar", "84": "Bihar", "85": "Bihar",
}

#: Words of addresses that name no area.
GENERIC = [
    "ROAD", "STREET", "NAGAR", "COLONY", "PLOT", "SECTOR", "BLOCK", "WARD", "SURVEY", "NEAR", "OPPOSITE", "OPP", "MAIN", "CROSS", "LANE", "AVENUE",
    "MARG", "PHASE", "FLOOR", "BUILDING", "POST", "DISTRICT", "TALUK", "TEHSIL", "VILLAGE", "TOWN", "HOSPITAL", "MEDICAL", "COLLEGE", "INSTITUTE",
    "UNIVERSITY", "INDIA", "BHARAT", "STATION", "RAILWAY", "JUNCTION", "EAST", "WEST", "NORTH", "SOUTH", "GATE", "CHOWK", "BAZAAR", "BAZAR", "MARKET",
    "PARK", "GARDEN",
]

#: Beginnings of address parts that aren't cities.
ADDRESS_START = r"(?i)^(plot|sector|block|door|flat|house|no\.|no |pin|survey|ward|ph\.|ph |near|opp|opposite)\b"

#: Patterns of degrees, in order, and the degree codes.
DEGREE_PATTERNS = [
    (r"M\.?C\.?H\.?", "MCH"), (r"D\.?N\.?B\.?", "DNB"), (r"D\.?M\.?", "DM"), (r"M\.?P\.?H\.?", "MPH"), (r"M\.?D\.?", "MD"), (r"M\.?S\.?", "MS"),
    (r"M\.?B\.?B\.?S\.?", "MBBS"), (r"DIPLOMA\s+IN", "DIPLOMA"), (r"DIP\.?\s+IN", "DIPLOMA"), (r"DIP\.?", "DIPLOMA"), (r"MASTER\s+OF\s+PUBLIC\s+HEALTH", "MPH"),
]
DEGREES = ["MCH", "DNB", "DM", "MPH", "MD", "MS", "MBBS", "MSC", "BSC", "DIPLOMA"]

#: Patterns that names, courses and addresses are cleaned by.
MAIL, TELEPHONE, PIN, WORD = r"\S+@\S+", r"[+\d][\d\s\-()]{7,}", r"\b\d{6}\b", "([A-Za-z']+)"
BRACKETS, SEPARATORS, SIGNS = r"[()\[\]]", r"\s*[-–—/]\s*", "[.,;:!?]"

#: Words that line breaks split.
SPLIT_WORDS = [
    ("E N T", "ENT"), ("VENEREOL OGY", "VENEREOLOGY"), ("VENE REOLOGY", "VENEREOLOGY"), ("VENERE AL", "VENEREAL"), ("OPHTHALMOLOG Y", "OPHTHALMOLOGY"),
    ("DOM S", "DOMS"), ("DERMATOLO GY", "DERMATOLOGY"), ("LEPRO SY", "LEPROSY"),
]

#: Keywords of course types, in order of precedence; whatever has none is Clinical.
COURSE_TYPES = [
    ("Pre-Clinical", ["ANATOMY", "PHYSIOLOGY", "BIO CHEMISTRY", "BIOCHEMISTRY"]),
    ("Para-Clinical", [
        "PATHOLOGY", "MICROBIOLOGY", "PHARMACOLOGY", "FORENSIC MEDICINE", "FORENSIC", "SOCIAL & PREVENTIVE", "SOCIAL AND PREVENTIVE", "COMMUNITY MEDICINE",
        "COMMUNITY HEALTH", "PREVENTIVE MEDICINE", "IMMUNO HAEMATOLOGY", "IMMUNO HEMATOLOGY", "BLOOD TRANSFUSION", "LAB MEDICINE", "LABORATORY MEDICINE", "TROPICAL MEDICINE",
    ]),
    ("Non-Clinical", [
        "HOSPITAL ADMINISTRATION", "HEALTH ADMINISTRATION", "PUBLIC HEALTH", "EPIDEMIOLOGY", "BIOSTATISTICS", "MEDICAL EDUCATION", "AVIATION MEDICINE", "AEROSPACE MEDICINE",
    ]),
]

#: Placeholders for "nothing" in cells.
DASHES = ["-", "—", "–", "NA", "N/A", ""]

#: Words of institute names that tell little.
STOP_WORDS = [
    "hospital", "medical", "college", "institute", "university", "govt", "government", "district", "general", "super", "speciality", "specialty",
    "centre", "center", "research", "national", "regional", "state", "pvt", "ltd", "private", "limited", "trust", "foundation", "society", "memorial",
    "of", "the", "and", "in", "at",
]

#: Years of service that a state's policy asks for; None: none.
BOND_YEARS = {
    "Andhra Pradesh": 1, "Arunachal Pradesh": 2, "Assam": 2, "Bihar": 3, "Chhattisgarh": 2, "Goa": 2, "Gujarat": 3, "Haryana": 1, "Himachal Pradesh": 2,
    "Jharkhand": 3, "Karnataka": 2, "Kerala": 2, "Madhya Pradesh": 2, "Maharashtra": 1, "Manipur": None, "Meghalaya": None, "Mizoram": 2, "Nagaland": 2,
    "Odisha": 2, "Punjab": 1, "Rajasthan": 1, "Sikkim": 3, "Tamil Nadu": 5, "Telangana": 1, "Tripura": 3, "Uttar Pradesh": 2, "Uttarakhand": 3,
    "West Bengal": 3, "Delhi": None, "Chandigarh": None, "Puducherry": 2, "Jammu and Kashmir": 3, "Ladakh": 3,
}

#: Patterns (in any case) that tell the state of a name and address, in order of precedence.
STATE_PATTERNS = {
    "Andhra Pradesh": [r"andhra\s*pradesh", r"\bA\.?P\.?\b"],
    "Arunachal Pradesh": [r"arunachal\s*pradesh"],
    "Assam": [r"\bassam\b"],
    "Bihar": [r"\bbihar\b", r"\bpatna\b"],
    "Chhattisgarh": [r"chhattisgarh", r"chattisgarh", r"\braipur\b"],
    "Delhi": [r"\bdelhi\b", r"\bnew\s*delhi\b"],
    "Goa": [r"\bgoa\b"],
    "Gujarat": [r"\bgujarat\b", r"\bahmedabad\b"],
    "Haryana": [r"\bharyana\b"],
    "Himachal Pradesh": [r"himachal\s*pradesh", r"\bshimla\b"],
    "Jammu and Kashmir": [r"jammu\s*(and|&)\s*kashmir", r"\bjammu\b", r"\bsrinagar\b", r"\bj\s*&\s*k\b"],
    "Jharkhand": [r"\bjharkhand\b", r"\branchi\b"],
    "Karnataka": [r"\bkarnataka\b", r"\bbangalore\b", r"\bbengaluru\b"],
    "Kerala": [r"\bkerala\b"],
    "Madhya Pradesh": [r"madhya\s*pradesh", r"\bbhopal\b", r"\bm\.?p\.?\b"],
    "Maharashtra": [r"\bmaharashtra\b", r"\bmumbai\b", r"\bpune\b"],
    "Manipur": [r"\bmanipur\b", r"\bimphal\b"],
    "Meghalaya": [r"\bmeghalaya\b", r"\bshillong\b"],
    "Mizoram": [r"\bmizoram\b", r"\baizawl\b"],
    "Nagaland": [r"\bnagaland\b"],
    "Odisha": [r"\bodisha\b", r"\borissa\b", r"\bbhubaneswar\b"],
    "Punjab": [r"\bpunjab\b"],
    "Puducherry": [r"\bpuducherry\b", r"\bpondicherry\b"],
    "Rajasthan": [r"\brajasthan\b", r"\bjaipur\b"],
    "Sikkim": [r"\bsikkim\b", r"\bgangtok\b"],
    "Tamil Nadu": [r"tamil\s*nadu\b", r"\bchennai\b", r"\bt\.?n\.?\b"],
    "Telangana": [r"\btelangana\b", r"\bhyderabad\b"],
    "Tripura": [r"\btripura\b", r"\bagartala\b"],
    "Uttar Pradesh": [r"uttar\s*pradesh", r"\blucknow\b", r"\bu\.?p\.?\b"],
    "Uttarakhand": [r"\buttarakhand\b", r"\bdehradun\b"],
    "West Bengal": [r"west\s*bengal", r"\bkolkata\b", r"\bcalcutta\b"],
    "Chandigarh": [r"\bchandigarh\b"],
    "Ladakh": [r"\bladakh\b", r"\bleh\b"],
    "Dadra and Nagar Haveli": [r"dadra\s*(and|&)\s*nagar\s*haveli", r"\bsilvassa\b"],
}
