"""Patterns, word lists, selectors and limits.

Everything in this module is data that decides results, so it is written out
plainly. Lists are ordered: the position is the priority.
"""

# --- Fixed values: board detection on a URL (first hit wins) -----------------
ATS_URL_PATTERNS = [
    ("greenhouse", r"(?i)greenhouse\.io"),
    ("lever", r"(?i)lever\.co"),
    ("ashby", r"(?i)ashbyhq\.com"),
    ("workday", r"(?i)myworkdayjobs\.com|workday\.com"),
    ("avature", r"(?i)avature\.net"),
    ("oracle_hcm", r"(?i)fa\.oraclecloud\.com.*hcmUI|taleo\.net|oraclecorp\.com.*hcm"),
    ("ibm", r"(?i)careers\.ibm\.com"),
]
GENERIC = "generic"

# --- Fixed values: careers-page discovery -----------------------------------
CAREERS_LINK = (
    r"(?i)\b(careers?|jobs?|work[-_]with[-_]us|join[-_]us|join[-_]our[-_]team|"
    r"opportunities|openings?|hiring|we[-_]are[-_]hiring|apply)\b"
)
CAREERS_PATH = r"(?i)/(careers?|jobs?|openings?|work[-_]with[-_]us|join|hiring|opportunities)"
BOARD_DOMAINS = (
    r"(?i)(boards\.greenhouse\.io|jobs\.lever\.co|ashbyhq\.com|"
    r"myworkdayjobs\.com|avature\.net|jobvite\.com|smartrecruiters\.com|"
    r"lever\.co|breezy\.hr|workable\.com)"
)
CAREERS_TAIL = r"(?i)/(careers?|jobs?)/?$"
CANDIDATE_PATHS = [
    "/careers",
    "/jobs",
    "/work-with-us",
    "/join-us",
    "/about/careers",
    "/company/careers",
    "/company/jobs",
    "/en/careers",
    "/en/jobs",
]

# --- Fixed values: fetch strategy per board type ----------------------------
# ats, strategy, ai_targeted, browser, network_idle
CRAWL_STRATEGIES = [
    ("greenhouse", "standard", True, False, False),
    ("lever", "standard", True, False, False),
    ("ashby", "browser", True, True, True),
    ("workday", "browser", True, True, True),
    ("avature", "standard", True, False, False),
    ("oracle_hcm", "scroll", False, True, True),
    ("ibm", "paginate", False, True, True),
    ("generic", "generic", False, False, True),
]
FETCH_COMMANDS = ["get", "fetch", "stealthy-fetch"]
MIN_CHARS = 2000
MIN_CHARS_GENERIC = 3000
SPA_SCAN_CHARS = 10000
SPA_MARKER = (
    r"(?is)id\s*=\s*[\"'](?:root|app)[\"']|"
    r"__NEXT_DATA__|__nuxt__|"
    r"<script[^>]*type=[\"']application/json|"
    r"content=[\"']application/ld\+json|"
    r"<noscript>.*?JavaScript|"
    r"document\.getElementById\([\"']"
)
MAX_PAGES = 100
MAX_SCROLL_ROUNDS = 30

# --- Fixed values: embedded boards and direct job links ---------------------
EMBED_PATTERNS = [
    ("ashby", r'(?i)src="(https://jobs\.ashbyhq\.com/[^"?]+)'),
    ("greenhouse", r'(?i)src="(https://(?:job-boards|boards)\.greenhouse\.io/[^"?]+)'),
    ("lever", r'(?i)src="(https://jobs\.lever\.co/[^"?]+)'),
    ("workday", r'(?i)src="(https://[^"]*myworkdayjobs\.com/[^"?]+)'),
    ("avature", r'(?i)src="(https://[^"]*avature\.net/[^"?]+)'),
    ("oracle_hcm", r'(?i)src="(https://[^"]*fa\.oraclecloud\.com/[^"?]+)'),
]
DIRECT_LINK_PATTERNS = [
    ("greenhouse", r"(?i)https://(?:job-boards|boards)\.greenhouse\.io/[^/\s\"']+/jobs/\d+"),
    ("lever", r"(?i)https://jobs\.lever\.co/[^/\s\"']+/[a-f0-9-]{36}"),
    ("ashby", r"(?i)https://jobs\.ashbyhq\.com/[^/\s\"']+/[a-f0-9-]{36}"),
    ("workday", r"(?i)https://[^/\s\"']+myworkdayjobs\.com/[^\s\"']+/job/"),
    ("avature", r"(?i)https://[^/\s\"']+avature\.net/[^\s\"']+/JobDetail/"),
    ("oracle_hcm", r"(?i)https://[^/\s\"']+fa\.oraclecloud\.com/hcmUI/[^\s\"']+/job/\d+"),
    ("generic", r"(?i)https://jobs\.jobvite\.com/[^/\s\"']+/job/[^\s\"']+"),
    ("generic", r"(?i)https://careers\.smartrecruiters\.com/[^/\s\"']+/[^\s\"']+"),
    ("generic", r"(?i)https://apply\.workable\.com/[^/\s\"']+/j/[A-Z0-9]+"),
    ("generic", r"(?i)https://[^/\s\"']+bamboohr\.com/careers/[^\s\"']+"),
    ("generic", r"(?i)https://ats\.rippling\.com/[^/\s\"']+/jobs/[^\s\"']+"),
    ("generic", r"(?i)https://[^/\s\"']+breezy\.hr/p/[^\s\"']+"),
]
UUID_HREF = r"(?i)^/[^/]+/[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
MIN_DIRECT_LINKS = 3
LINK_NAV_NOISE = r"(?i)^(learn\s*more|apply|→|>|view|see\s*job|open\s*role)$"
LINK_TRAILING_NOISE = r"(?i)[\s→>]+(?:learn\s*more|apply|view)?$"
LINK_LOCATION_CLASS = r"(?i)location|city|region"
LINK_LOCATION_HINT = (
    r"(?i)\b(remote|hybrid|office|san francisco|new york|london|berlin|toronto|"
    r"austin|seattle|boston|chicago|los angeles|singapore|tokyo|paris|"
    r"amsterdam|sydney|bangalore|dublin|tel aviv|vancouver|denver|atlanta|"
    r"united states|usa|uk|canada|europe|apac|emea|latam|worldwide|global)\b"
)

# --- Fixed values: listing extraction on any board --------------------------
JOB_URL = (
    r"(?i)(/jobs?/|/careers?/|/openings?/|/positions?/|/apply/|"
    r"/job-detail|/JobDetail|/requisition)"
    r"|[/_-]\d{5,}"
    r"|[/_][a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
)
BOARD_NAV_NOISE = (
    r"(?i)^(apply(\s+now)?|learn\s+more|view|see\s+job|open\s+role|→|>|details?|"
    r"read\s+more|click\s+here|more\s+info|submit|get\s+started|save|"
    r"save\s+job|bookmark|share|refer|referral)$"
)
BOARD_LOCATION_CLASS = r"(?i)location|city|region|locale|office|geo"
BOARD_LOCATION_TEXT = (
    r"(?i)\b(remote|hybrid|on.?site|san francisco|new york|london|berlin|toronto|"
    r"seattle|boston|chicago|los angeles|austin|singapore|tokyo|paris|"
    r"amsterdam|sydney|bangalore|dublin|denver|atlanta|united states|usa|"
    r"u\.s\.|canada|europe|apac|emea|latam|worldwide|global)\b"
)
LOCATION_SEPARATORS = ["•", "·", "|", "/"]
CARD_STOP_TAGS = ["body", "main", "section", "article", "ul", "ol", "table", "tbody", "thead", "html"]
MIN_BOARD_LINKS = 2
MAX_TITLE_CHARS = 120
GENERIC_LOCATION_CLASS = r"(?i)(location|city|region|remote|office)"

# --- Fixed values: tag sets removed before extraction -----------------------
PAGE_NOISE_TAGS = ["script", "style", "noscript", "nav", "header", "footer"]
BOARD_NOISE_TAGS = ["aside", "form", "iframe"]

# --- Fixed values: description enrichment -----------------------------------
DESCRIPTION_SELECTORS = {
    "greenhouse": ["#content #app_body", "#content .section", "#app_body", ".job-post__description"],
    "lever": ["div.content", "div.posting-content", ".posting-description"],
    "ashby": ["div[class*='posting']", "div[class*='jobContent']", "div[class*='content']", "main"],
    "workday": ["div[data-automation-id='jobPostingDescription']", "div[class*='job-description']", "main"],
    "avature": [".article__body", "div[class*='job-detail']", "main"],
    "oracle_hcm": ["div[data-automation-id='richTextDescription']", "div[class*='job-description']", "main"],
    "generic": [
        "main",
        "article",
        "div[class*='description']",
        "div[class*='content']",
        "div[class*='job-detail']",
        "div[class*='posting']",
        "section",
        "body",
    ],
}
DESCRIPTION_NOISE = (
    r"(?i)(apply now|share this job|back to jobs|equal opportunity|"
    r"we are an equal|eeo|accessibility|cookie|privacy policy)"
)
MIN_DESCRIPTION_CHARS = 100
MIN_DETAIL_CHARS = 150
MAX_DESCRIPTION_CHARS = 4000

# --- Fixed values: matching --------------------------------------------------
STOP_WORDS = (
    "a an the and or but in on at to for of with is are was were be been "
    "have has had do does did will would could should may might must can "
    "i we you he she they it this that these those our your their"
).split()
JOB_AD_WORDS = (
    "role team work experience ability strong including "
    "across build building drive driving years looking "
    "passionate excited opportunity skills required preferred "
    "join help use using used new great best high "
    "well also make ensure contribute good key core "
    "within following understand understanding knowledge ability "
    "responsible responsibilities qualifications requirements "
    "like love enjoy want care impact world people "
    "company business product products customer customers "
    "solutions solve problems problem challenges challenge "
    "environment culture values mission vision growth "
    "benefits equity salary compensation offer offering "
    "apis api app apps deploy deployment scalable scale "
    "collaborate collaboration cross functional ownership own "
    "plus bonus nice have degree bs ms phd related "
    "field equivalent practice "
    "software engineer engineering developer development "
    "manager management analyst associate specialist lead "
    "senior junior staff principal director head vp "
    "intern contract full time part remote hybrid "
    "levels level all mid entry backend frontend "
    "fullstack full-stack back-end front-end"
).split()
SENIOR_TITLE = r"(?i)\b(senior|sr\.?|staff|principal|lead|director|vp|vice\s+president)\b"
EDUCATION_LINE = r"^\s*(education|academic|degree|university|college|school)\b"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
OPEN_END_WORDS = ["present", "current", "now"]
CURRENT_YEAR = 2025
TITLE_WEIGHT, DESCRIPTION_WEIGHT = 1, 3
RESUME_TOP_TERMS, JOB_TOP_TERMS = 50, 30
