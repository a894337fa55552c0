"""Fixed values.

Everything here is data that the results depend on: category names, caps, word
lists, regular expressions, lookup tables and default texts.  Logic lives in
``functions`` and ``operators``.
"""

# --- fixed values: categories and caps ---------------------------------------
CATEGORIES = ("results", "admit_cards", "latest_jobs", "answer_keys", "private_jobs", "remote_jobs")

CATEGORY_CAPS = {
    "latest_jobs": 36,
    "results": 20,
    "admit_cards": 20,
    "answer_keys": 18,
    "private_jobs": 24,
    "remote_jobs": 24,
}
OFFICIAL_SOURCE_CAPS = {
    "upsc_active": 12,
    "upsc_recruitment": 6,
    "ibps_recruitment": 12,
    "rac_recruitment": 4,
}
PAGE_LIMIT = 10
STATE_PAGE_LIMIT = 1
HOME_LIMIT = 10
TEXT_SLICE = 2500
SKILL_SLICE = 10

# --- fixed values: source groups in run order, and run sources ----------------
SOURCE_GROUPS = ("SR", "FJA", "SE", "SU", "OFFICIAL", "PRIVATE", "REMOTE")
# Groups whose listings are market listings.
MARKET_GROUPS = ("PRIVATE", "REMOTE")

RUN_SOURCES = (
    "sarkariresult", "freejobalert", "sarkariexam", "sarkariujala", "official_portals",
    "internshala", "freshersworld", "naukri", "indeed", "remoteok", "weworkremotely",
    "remotive", "flexjobs",
)
IDLE_SOURCES = ("sarkariresult", "freejobalert", "sarkariexam")

# --- fixed values: site domains, listing pages, skip lists ---------------------
SITE_DOMAINS = {
    "SR": "sarkariresult.com",
    "FJA": "freejobalert.com",
    "SE": "sarkariexam.com",
    "SU": "sarkariujala.com",
}
# Sites whose own domain is exempt from the competitor test; SU has no entry.
OWN_DOMAINS = {
    "SR": "sarkariresult.com",
    "FJA": "freejobalert.com",
    "SE": "sarkariexam.com",
}
SITE_PAGES = {
    "SR": [
        ("https://www.sarkariresult.com/latestjob/", "latest_jobs"),
        ("https://www.sarkariresult.com/result/", "results"),
        ("https://www.sarkariresult.com/admitcard/", "admit_cards"),
        ("https://www.sarkariresult.com/answerkey/", "answer_keys"),
    ],
    "FJA": [
        ("https://www.freejobalert.com/latest-notifications/", "latest_jobs"),
        ("https://www.freejobalert.com/government-jobs/", "latest_jobs"),
        ("https://www.freejobalert.com/bank-jobs/", "latest_jobs"),
        ("https://www.freejobalert.com/railway-jobs/", "latest_jobs"),
        ("https://www.freejobalert.com/police-defence-jobs/", "latest_jobs"),
        ("https://www.freejobalert.com/teaching-faculty-jobs/", "latest_jobs"),
        ("https://www.freejobalert.com/admit-card/", "admit_cards"),
        ("https://www.freejobalert.com/exam-results/", "results"),
        ("https://www.freejobalert.com/answer-key/", "answer_keys"),
    ],
    "SE": [
        ("https://www.sarkariexam.com/category/top-online-form/", "latest_jobs"),
        ("https://www.sarkariexam.com/category/hot-job/", "latest_jobs"),
        ("https://www.sarkariexam.com/category/exam-result/", "results"),
        ("https://www.sarkariexam.com/category/admit-card/", "admit_cards"),
        ("https://www.sarkariexam.com/category/answer-keys/", "answer_keys"),
    ],
    "SU": [
        ("https://sarkariujala.com/category/new-update", "latest_jobs"),
        ("https://sarkariujala.com/category/form", "latest_jobs"),
        ("https://sarkariujala.com/category/sarkari-result", "results"),
        ("https://sarkariujala.com/category/admit-card", "admit_cards"),
    ],
}
# --- fixed values: state pages of FJA
STATE_PAGES = {
    "Andhra Pradesh": "https://www.freejobalert.com/ap-government-jobs/",
    "Assam": "https://www.freejobalert.com/assam-government-jobs/",
    "Bihar": "https://www.freejobalert.com/bihar-government-jobs/",
    "Chhattisgarh": "https://www.freejobalert.com/chhattisgarh-government-jobs/",
    "Delhi": "https://www.freejobalert.com/delhi-government-jobs/",
    "Gujarat": "https://www.freejobalert.com/gujarat-government-jobs/",
    "Haryana": "https://www.freejobalert.com/haryana-government-jobs/",
    "Himachal Pradesh": "https://www.freejobalert.com/hp-government-jobs/",
    "Jharkhand": "https://www.freejobalert.com/jharkhand-government-jobs/",
    "Karnataka": "https://www.freejobalert.com/karnataka-government-jobs/",
    "Kerala": "https://www.freejobalert.com/kerala-government-jobs/",
    "Madhya Pradesh": "https://www.freejobalert.com/mp-government-jobs/",
    "Maharashtra": "https://www.freejobalert.com/maharashtra-government-jobs/",
    "Odisha": "https://www.freejobalert.com/odisha-government-jobs/",
    "Punjab": "https://www.freejobalert.com/punjab-government-jobs/",
    "Rajasthan": "https://www.freejobalert.com/rajasthan-government-jobs/",
    "Tamil Nadu": "https://www.freejobalert.com/tn-government-jobs/",
    "Telangana": "https://www.freejobalert.com/telangana-government-jobs/",
    "Uttar Pradesh": "https://www.freejobalert.com/up-government-jobs/",
    "Uttarakhand": "https://www.freejobalert.com/uttarakhand-government-jobs/",
    "West Bengal": "https://www.freejobalert.com/wb-government-jobs/",
}
SKIP_TITLES = (
    "home", "view more", "search", "contact us", "important", "syllabus", "notifications",
    "latest notifications", "latest jobs", "admit card", "answer key", "exam results",
)
SKIP_PATHS = {
    "SR": ["/latestjob/", "/result/", "/admitcard/", "/answerkey/", "/syllabus/", "/search/",
           "/contactus/", "/important/"],
    "FJA": ["/government-jobs/", "/state-government-jobs/", "/latest-notifications/", "/admit-card/",
            "/exam-results/", "/answer-key/", "/bank-jobs/", "/teaching-faculty-jobs/",
            "/engineering-jobs/", "/railway-jobs/", "/police-defence-jobs/", "/employment-news/",
            "/search-jobs/"],
    "SE": ["/category/"],
    "SU": ["/category/", "/page/"],
}
MIN_TITLE_LENGTH = 10

# --- fixed values: signal terms and years ---------------------------------------
SIGNAL_YEAR = r"\b20(2[4-9]|3\d)\b"
ANY_YEAR = r"\b(20\d{2})\b"
SIGNAL_TERMS = {
    "latest_jobs": ["online form", "apply online", "recruitment", "vacancy", "vacancies",
                    "notification", "jobs", "job", "bharti", "post", "posts", "walk in"],
    "results": ["result", "results", "score", "score card", "merit", "selection", "cut off"],
    "admit_cards": ["admit", "exam city", "hall ticket", "call letter", "schedule", "city intimation"],
    "answer_keys": ["answer key", "response sheet", "objection", "provisional key", "final key"],
}

# --- fixed values: competitor, app-store and social strings ----------------------
COMPETITORS = (
    "sarkariresult.com", "sarkariresult", "sarkari result",
    "freejobalert.com", "freejobalert", "free job alert",
    "sarkariexam.com", "sarkariexam", "sarkari exam",
    "naukri.com", "shine.com", "freshersworld.com", "rojgarresult.com",
    "sarkari naukri", "sarkarinaukri", "careersage.in", "employmentnews",
    "indgovtjobs", "sarkariwallahs", "sarkarimaster",
)
APP_PHRASES = (
    "play.google.com", "apps.apple.com", "app.adjust.com", "onelink.me", "apkpure.com",
    "apkmirror.com", "download app", "get app", "install app", "download now the app",
    "google play", "app store", "available on play store", "download on the", "android app",
    "ios app",
)
SOCIAL_HOSTS = (
    "facebook.com", "twitter.com", "instagram.com", "youtube.com", "youtu.be", "whatsapp.com",
    "wa.me", "t.me", "telegram.me", "linkedin.com", "pinterest.com", "snapchat.com",
)
IMAGE_ALT_BRANDS = ("sarkari", "freejobalert", "sarkariexam")

# --- fixed values: brand rewrites, applied in this order --------------------------
BRAND_PATTERNS = (
    r"Sarkari\s*Result\.?\s*Com|Sarkari\s*Result",
    r"freejobalert\.com|Free\s*Job\s*Alert",
    r"sarkariexam\.com|Sarkari\s*Exam",
    r"rojgarresult\.com|RojgarResult",
    r"sarkarinaukri\.com|Sarkari\s*Naukri",
)
# Every brand pattern and app-store phrase holds one of these (the last is a letter that equals "s" in
# matches without case).
SCRUB_HINTS = ("sarkari", "alert", "rojgar", "app", "play", "onelink", "apk", "download on", "\u017f")
DEFAULT_HOUSE = "JobMill"

# --- fixed values: HTML cleaning ---------------------------------------------------
JUNK_CLASS = (
    r"share|social|addtoany|fb-|whatsapp|telegram|app-download|download-app|"
    r"mobile-app|get-app|playstore|appstore|ad-|ads-|advertisement|"
    r"comments?|comment-form|related-posts?|newsletter|subscribe|signup|"
    r"sidebar|widget|breadcrumb|navigation|footer|header|menu|navbar|"
    r"popup|modal|overlay|cookie|gdpr|notification|alert-bar"
)
DEEP_DROP_TAGS = ("script", "style", "iframe", "noscript", "meta", "link")
OFFICIAL_DROP_TAGS = ("script", "style", "iframe", "noscript", "svg", "img", "meta", "link")
MARKET_DROP_TAGS = ("script", "style", "iframe", "img", "noscript", "svg", "form")
SCRUBBED_ATTRIBUTES = ("title", "alt", "aria-label")
DROPPED_LINK_ATTRIBUTES = ("target", "onclick", "onmouseover")

# --- fixed values: allow / deny words of the bank recruitment source (whole words) -------
ALLOW_WORDS = (
    "PSB", "IDBI", "IIFCL", "NABFID", "NABARD", "SIDBI", "SBI",
    "PNB", "BOB", "Bank of India", "Indian Bank", "Central Bank",
    "Canara", "Union Bank",
)
DENY_WORDS = ("programme", "pgip", "co-operative", "special recruitment drive")

# --- fixed values: scope words (whole words; "?" as in a pattern) ---------------------------
REMOTE_WORDS = ("remote",)
ALL_INDIA_WORDS = (
    "all india", "all states", "nationwide", "pan india", "across india",
)
CENTRAL_WORDS = (
    "central govt", "central government", "upsc", "ssc", "railway",
    "rrb", "ibps", "sbi", "indian army", "indian navy",
    "indian air ?force", "agniveer", "drdo", "nielit", "ctet",
    "neet", "nta",
)

# --- fixed values: key facts in free text ----------------------------------------------
LAST_DATE_PATTERNS = (
    r"last\s*date[:\s]+([A-Z][a-z]{2,8}[\s\d,]+\d{4}|[\d/\-]+\s*\d{4})",
    r"last\s*date\s*[:\-]\s*([\d\-\/]+)",
)
VACANCY_PATTERN = r"(\d[\d,]+)\s*(?:post|vacancy|vacancies|seat)"
EXAM_DATE_PATTERN = r"exam\s*date[:\s]+([A-Z][a-z]{2,8}[\s\d,]+\d{4}|[\d/\-]+\s*\d{4})"
TITLE_LABELS = (
    "UPSC", "SSC", "Railway", "RRB", "Banking", "IBPS", "SBI", "Defence", "Army", "Navy",
    "Air Force", "Police", "Teaching", "CTET", "TET",
)
UPDATED_PATTERN = r"Last updated:\s*(.*?)(?:Closing date:|$)"
CLOSING_PATTERN = r"Closing date:\s*(.+)$"
POSTED_PATTERN = r"Posted:\s*(.+?)\s+(?:Save|View\s*&\s*Apply|$)"
SIZE_NOTE_PATTERN = r"\(\s*\d[\d.,]*\s*(?:KB|MB)\s*\)"
RAC_TITLE = "DRDO RAC Advertisement No. "
OFFICIAL_LINK_LABEL = "Official link"
CARD_NOISE_PATTERN = r"\b(?:Less|More)\b"

# --- fixed values: applicant totals ------------------------------------------------------
COUNT_TOKEN = r"(\d[\d,]*(?:\.\d+)?)\s*(lakh|crore|million)?"
# (basis, what surrounds the count token); {n} is the token, tried in this order.
APPLICANT_PATTERNS = (
    ("applied", r"{n}\s+(?:candidates?|applicants?)\s+(?:have\s+)?applied\b"),
    ("registered", r"{n}\s+(?:candidates?|applicants?)\s+(?:have\s+been\s+)?registered\b"),
    ("applications received", r"{n}\s+applications?\s+(?:were\s+|have\s+been\s+)?received\b"),
    ("appeared", r"{n}\s+(?:candidates?|students?)\s+(?:have\s+)?appeared\b"),
    ("qualified", r"{n}\s+(?:candidates?|students?)\s+(?:have\s+)?qualified\b"),
    ("registered", r"total\s+registered\s+(?:candidates?|applicants?)\s*[:\-]?\s*{n}"),
    ("applied", r"total\s+(?:candidates?|applicants?)\s+applied\s*[:\-]?\s*{n}"),
    ("appeared", r"total\s+(?:candidates?|students?)\s+appeared\s*[:\-]?\s*{n}"),
)
APPLICANT_LABELS = {
    "applied": "Applied",
    "registered": "Registered",
    "applications received": "Applications Received",
    "appeared": "Appeared",
    "qualified": "Qualified",
}
UNIT_FACTORS = {"lakh": 100000, "crore": 10000000, "million": 1000000}

# --- fixed values: default texts ------------------------------------------------------------
INFO_DEFAULTS = {
    "last_date": "See Notification",
    "vacancies": "Various",
    "exam_date": "As per Schedule",
    "info_category": "Central Govt",
    "applicant_count_display": "",
    "applicant_metric_label": "Not officially disclosed",
    "applicant_metric_note": "Applicant or participant totals have not been officially disclosed yet.",
    "applicant_metric_basis": "not_disclosed",
}
MARKET_DEFAULTS = {"last_date": "Apply ASAP", "vacancies": "See listing", "exam_date": "Recently posted"}
CARD_DEFAULTS = {
    "location": "Location not specified",
    "remote_location": "Remote",
    "highlight": "See listing",
    "posted": "Recently updated",
}
POST_DEFAULTS = {
    "coverage": "All India",
    "applicants": "Not disclosed yet",
    "label": "Not officially disclosed",
    "note": "Applicant or participant totals have not been officially disclosed yet.",
}
# Manual rows: key in the file -> (category, default org, default cat)
MANUAL_KEYS = {
    "jobs": ("latest_jobs", "Official", "Job"),
    "results": ("results", "Official", "Result"),
    "admitcard": ("admit_cards", "Official", "Updates"),
    "answerkey": ("answer_keys", "Official", "Updates"),
}
# Category pages: constants shown next to scraped rows.
RICH_CONSTANTS = {
    "latest_jobs": ("hot", "Govt Job", "", ""),
    "results": ("out", "Result", "OUT", "Just Now"),
    "admit_cards": ("out", "", "OUT", "Just Now"),
    "answer_keys": ("new", "FINAL", "", "Closed"),
}
CATEGORY_LABELS = {
    "latest_jobs": "Latest Jobs 2026",
    "results": "{house} Result 2026",
    "admit_cards": "Admit Card 2026",
    "answer_keys": "Answer Key 2026",
    "private_jobs": "Private Jobs 2026",
    "remote_jobs": "Remote Jobs 2026",
}
CATEGORY_LABEL_DEFAULT = "{house} Update 2026"
CATEGORY_SECTIONS = {
    "latest_jobs": ["Important Dates", "Vacancies & Category", "Age Limit", "Qualification",
                    "Application Fee", "How to Apply", "Official Links"],
    "results": ["Result Status", "Cut Off Marks", "Score Card Download", "Merit List", "Next Steps",
                "Official Links"],
    "admit_cards": ["Exam Date", "Download Admit Card", "Important Instructions", "Exam Pattern",
                    "Official Links"],
    "answer_keys": ["Download Answer Key", "Raise Objections", "Expected Cut Off", "Result Date",
                    "Official Links"],
    "private_jobs": ["Role Snapshot", "Company Details", "Location & Salary", "Experience", "Skills",
                     "Original Listing"],
    "remote_jobs": ["Role Snapshot", "Remote Location", "Compensation", "Experience", "Skills",
                    "Original Listing"],
}
# Home tiles: tile -> (category, manual key or empty)
HOME_TILES = {
    "government-jobs": ("latest_jobs", "jobs"),
    "latest-jobs": ("latest_jobs", "jobs"),
    "private-jobs": ("private_jobs", ""),
    "remote-jobs": ("remote_jobs", ""),
    "admit-cards": ("admit_cards", "admitcard"),
    "results": ("results", "results"),
}
COUNT_TILES = ("latest_jobs", "private_jobs", "remote_jobs")

# --- fixed values: heading words of homepage blocks, tested in this order ---------------------
HEADING_MAPS = {
    "SR": [("result", "results"), ("admit card", "admit_cards"), ("latest job", "latest_jobs"),
           ("online form", "latest_jobs"), ("answer key", "answer_keys")],
    "FJA": [("result", "results"), ("admit card", "admit_cards"), ("notification", "latest_jobs"),
            ("updates", "latest_jobs"), ("answer key", "answer_keys")],
    "SE": [("result", "results"), ("admit card", "admit_cards"), ("exam", "results"),
           ("online form", "latest_jobs"), ("new updates", "latest_jobs"),
           ("answer key", "answer_keys")],
}
SECTION_HEADING_CLASS = r"nutitle|gb-headline|widget-title|section-head"
BODY_CLASS = {
    "SR": r"postab|post-content|post_detail",
    "FJA": r"entry-content|post-content|single-post",
    "SE": r"entry-content|post-content|single-post",
    "SU": r"entry-content|post-content|single-post",
}

# --- fixed values: document locker ---------------------------------------------------------------
LOCKER_LABELS = {
    "certificate": "Certificate",
    "marksheet": "Marksheet",
    "id": "ID Proof",
    "photo": "Photo",
    "other": "Other",
}
LOCKER_CHECKLIST = (
    "10th Marksheet", "12th Marksheet", "Graduation Certificate", "Aadhar Card", "PAN Card",
    "Passport Photo", "Caste Certificate", "Income Certificate", "Domicile Certificate",
    "NCC / NSS Certificate", "Character Certificate",
)
LOCKER_MAX_DOCS = 20
LOCKER_MAX_BYTES = 5 * 1024 * 1024
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png")

# --- fixed values: exam age rules (name, min, general, obc, sc/st, pwd) ----------------------------
EXAM_RULES = (
    ("UPSC CSE (IAS)", 21.0, 32.0, 35.0, 37.0, 42.0),
    ("SSC CGL", 18.0, 32.0, 35.0, 37.0, 42.0),
    ("SSC CHSL", 18.0, 27.0, 30.0, 32.0, 37.0),
    ("SSC MTS", 18.0, 27.0, 30.0, 32.0, 37.0),
    ("SSC GD Constable", 18.0, 23.0, 26.0, 28.0, 33.0),
    ("RRB NTPC Graduate", 18.0, 33.0, 36.0, 38.0, 43.0),
    ("RRB ALP", 18.0, 28.0, 31.0, 33.0, 38.0),
    ("RRB Group D", 18.0, 36.0, 39.0, 41.0, 46.0),
    ("SBI PO", 21.0, 30.0, 33.0, 35.0, 40.0),
    ("IBPS PO", 20.0, 30.0, 33.0, 35.0, 40.0),
    ("NDA Exam", 16.5, 19.5, 19.5, 19.5, 19.5),
    ("UPSC CDS", 19.0, 25.0, 25.0, 25.0, 25.0),
    ("Army Agniveer", 17.5, 23.0, 23.0, 23.0, 23.0),
)

# --- fixed values: state directory (name, type, portal, aliases), order matters -----------------------
STATE_DIRECTORY = (
    ("All India", "central", "https://www.upsc.gov.in/",
     ["all india", "nationwide", "pan india", "across india"]),
    ("Central Govt", "central", "https://www.upsc.gov.in/",
     ["central govt", "central government", "government of india"]),
    ("Andhra Pradesh", "state", "https://psc.ap.gov.in/", ["andhra pradesh", "appsc"]),
    ("Arunachal Pradesh", "state", "https://appsc.gov.in/", ["arunachal pradesh"]),
    ("Assam", "state", "https://apsc.nic.in/", ["assam", "assam public service commission"]),
    ("Bihar", "state", "https://bpsc.bihar.gov.in/",
     ["bihar", "bpsc", "btsc", "csbc", "bceceb", "ofss bihar"]),
    ("Chhattisgarh", "state", "https://psc.cg.gov.in/", ["chhattisgarh", "cgpsc", "cg vyapam"]),
    ("Goa", "state", "https://gpsc.goa.gov.in/", ["goa"]),
    ("Gujarat", "state", "https://gpsc.gujarat.gov.in/", ["gujarat", "gpsc gujarat", "gsssb"]),
    ("Haryana", "state", "https://hpsc.gov.in/", ["haryana", "hssc", "hpsc"]),
    ("Himachal Pradesh", "state", "https://hppsc.hp.gov.in/", ["himachal pradesh", "hppsc"]),
    ("Jharkhand", "state", "https://www.jpsc.gov.in/", ["jharkhand", "jpsc", "jssc"]),
    ("Karnataka", "state", "https://kpsc.kar.nic.in/", ["karnataka", "kpsc", "kea"]),
    ("Kerala", "state", "https://www.keralapsc.gov.in/", ["kerala", "kerala psc"]),
    ("Madhya Pradesh", "state", "https://mppsc.mp.gov.in/",
     ["madhya pradesh", "mppsc", "mpesb", "esb mp"]),
    ("Maharashtra", "state", "https://mpsc.gov.in/", ["maharashtra", "mpsc maharashtra"]),
    ("Manipur", "state", "https://mpscmanipur.gov.in/", ["manipur"]),
    ("Meghalaya", "state", "https://mpsc.nic.in/", ["meghalaya"]),
    ("Mizoram", "state", "https://mpsc.mizoram.gov.in/", ["mizoram"]),
    ("Nagaland", "state", "https://npsc.nagaland.gov.in/", ["nagaland"]),
    ("Odisha", "state", "https://www.opsc.gov.in/", ["odisha", "orissa", "opsc"]),
    ("Punjab", "state", "https://www.ppsc.gov.in/", ["punjab", "ppsc", "pspcl"]),
    ("Rajasthan", "state", "https://rpsc.rajasthan.gov.in/", ["rajasthan", "rpsc"]),
    ("Sikkim", "state", "https://spsc.sikkim.gov.in/", ["sikkim"]),
    ("Tamil Nadu", "state", "https://www.tnpsc.gov.in/", ["tamil nadu", "tnpsc"]),
    ("Telangana", "state", "https://www.tgpsc.gov.in/", ["telangana", "tgpsc", "tspsc"]),
    ("Tripura", "state", "https://tpsc.tripura.gov.in/",
     ["tripura", "tripura public service commission"]),
    ("Uttar Pradesh", "state", "https://uppsc.up.nic.in/",
     ["uttar pradesh", "uppsc", "upsssc", "uptet", "upsrtc", "up scholarship"]),
    ("Uttarakhand", "state", "https://psc.uk.gov.in/", ["uttarakhand", "ukpsc"]),
    ("West Bengal", "state", "https://psc.wb.gov.in/", ["west bengal", "wbpsc"]),
    ("Andaman and Nicobar Islands", "ut", "https://erecruitment.andaman.gov.in/",
     ["andaman and nicobar", "andaman nicobar", "a&n islands"]),
    ("Chandigarh", "ut", "https://chandigarh.gov.in/", ["chandigarh"]),
    ("Dadra and Nagar Haveli and Daman and Diu", "ut", "https://ddd.gov.in/",
     ["dadra and nagar haveli and daman and diu", "daman and diu", "dadra and nagar haveli"]),
    ("Delhi", "ut", "https://dsssb.delhi.gov.in/", ["delhi", "dsssb", "nct delhi"]),
    ("Jammu and Kashmir", "ut", "https://jkpsc.nic.in/", ["jammu and kashmir", "j&k", "jkpsc"]),
    ("Ladakh", "ut", "https://ladakh.nic.in/notice_category/recruitment/", ["ladakh"]),
    ("Lakshadweep", "ut", "https://lakshadweep.gov.in/", ["lakshadweep"]),
    ("Puducherry", "ut", "https://recruitment.py.gov.in/", ["puducherry", "pondicherry"]),
)

# --- fixed values: HTML elements without an end tag, and elements whose text is not page text -------------
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
)
RAW_TEXT_TAGS = ("script", "style", "template", "rt", "rp")
KEEP_SPACE_TAGS = ("pre", "textarea")

# --- fixed values: where the cards of each site are (site, card, card selector, fields) ------------------------
# A field is (name, selector within the card or '' for the card itself, attribute or '' for the text, which match).
CARD_SELECTORS = (
    ("internshala", 0, ".individual_internship", (
        ("title", ".job-title-href", "", 0), ("href", ".job-title-href", "href", 0), ("company", ".company-name", "", 0),
        ("job_location", ".locations", "", 0), ("salary", ".detail-row-1 .row-1-item", "", 1),
        ("experience", ".detail-row-1 .row-1-item", "", 2), ("posted_at", ".status-success", "", 0), ("skills", ".job_skill", "", -1))),
    ("freshersworld", 0, ".job-container", (
        ("title", ".job-new-title .wrap-title.seo_title", "", 0), ("href", "", "job_display_url", 0), ("company", ".company-name", "", 0),
        ("job_location", ".job-location", "", 0), ("experience", ".experience", "", 0),
        ("salary", ".qualification-block .job-details-span", "", 0), ("qualification", ".qualification-block .job-details-span", "", 1),
        ("card_text", "", "", 0))),
    ("naukri", 0, "div.srp-jobtuple-wrapper, article.jobTuple", (
        ("title", "a.title", "", 0), ("href", "a.title", "href", 0), ("company", "a.comp-name", "", 0),
        ("job_location", ".locWdth", "", 0), ("experience", ".expwdth", "", 0))),
    ("indeed", 0, "td.resultContent", (
        ("title", "h2.jobTitle a", "", 0), ("href", "h2.jobTitle a", "href", 0), ("company", "span.companyName", "", 0),
        ("job_location", "div.companyLocation", "", 0))),
    ("flexjobs", 0, "li.m-0", (
        ("title", "a.job-title", "", 0), ("href", "a.job-title", "href", 0), ("summary", ".job-description", "", 0))),
    ("ibps", 0, 'a[href*="ibpsreg.ibps.in"]', (
        ("href", "", "href", 0), ("card_text", "", "", 0), ("org", ".detail-first-heading", "", 0), ("role", ".detail-second-heading", "", 0),
        ("start_date", ".detail-third-heading .detail-heading > div", "", 0), ("end_date", ".detail-third-heading .detail-heading > div", "", 1))),
    ("rac", 0, 'div[data-bs-target^="#offcanvas"]', (
        ("target", "", "data-bs-target", 0), ("number", ".advtHeading", "", 0), ("card_text", "", "", 0), ("summary", "", "", 0))),
    ("upsc_active", 0, "div.view-content div.views-row a[href]", (("title", "", "", 0), ("href", "", "href", 0))),
    ("upsc_recruitment", 0, "div.view-content li", (("title", "", "", 0), ("href", "a[href]", "href", 0))),
    ("upsc_detail", 0, "div.view-content", (("upload_date", ".date-display-single", "", 0), ("detail_text", "", "", 0))),
    ("upsc_detail", 1, "div.region-content", (("upload_date", ".date-display-single", "", 0), ("detail_text", "", "", 0))),
)
CARD_FALLBACKS = {("ibps", "org"): "IBPS"}
CARD_WORDS = {("rac", "summary"): ["selection of", "scientist"]}
UPSC_PREFIX = "UPSC"
UPSC_EXAM_DATE = "As per UPSC schedule"
