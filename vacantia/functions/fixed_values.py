"""Word lists, patterns and tables that results depend on.

Patterns are written in the syntax shared by java.util.regex and RE2, without flags; the
caller adds the flags.  Spark needs (?iU) so that word characters and boundaries are Unicode.
"""

# ---- providers -------------------------------------------------------------------------

PROVIDERS = ("greenhouse", "lever", "workday", "workable", "ashby", "crawler", "github")
LEVELS = ("junior", "mid", "senior", "unknown")
PROVIDER_STATUS = {
    "greenhouse": "supported",
    "github": "supported",
    "ashby": "experimental",
    "workday": "experimental",
    "lever": "experimental",
    "microsoft": "planned",
    "coalition": "planned",
}
REGISTERED_SOURCES = ("greenhouse", "lever", "workday", "ashby", "workable")

# ---- entry-level decision --------------------------------------------------------------

ENTRY_EXCLUSION_TITLE = r"\b(senior|sr\.?|staff|principal|lead|manager|director|head)\b"
ENTRY_INCLUSION_TITLE = r"\b(intern|new\s*grad|junior|entry|associate)\b"
PLUS_YEARS = r"\b(\d+)\s*\+\s*(?:years?|yrs?)\b"
# The same wording with a number of at least 3.
PLUS_3_YEARS = r"\b0*(?:[3-9]|[1-9]\d+)\s*\+\s*(?:years?|yrs?)\b"
ENTRY_TITLE_TERMS = ("senior", "sr", "staff", "principal", "lead", "manager", "director", "head")
ENTRY_LIKE_YEARS = range(3, 16)

# ---- engineering and junior tests ------------------------------------------------------

CORE_SWE_HINTS = (
    r"\b(software|full[- ]?stack|fullstack|front[- ]?end|frontend|back[- ]?end|backend|platform|web|mobile"
    r"|ios|android|data|ml|machine\s*learning|devops|swe|sre|site\s*reliability|security|infrastructure)\b"
)
GENERIC_ENGINEER = r"\b(engineer|developer)\b"
NON_SWE_ENGINEER = (
    r"\b(sales|account|customer|support|success|implementation|solutions|field|pre[- ]?sales"
    r"|professional\s*services|broadcast|audio|video|a\/?v|av)\s+(engineer|engineering)\b"
)
SENIOR_BLOCK = r"\b(senior|staff|principal|lead|manager|architect|s\.?r\.?)\b"
JUNIOR_TITLE = (
    r"\b(junior|new\s*grad|entry[\-\s]*level|associate"
    r"|(?:software|swe|sde|se|developer|engineer)\s*(?:i|1|i\.))\b"
)
ENGINEER_L2 = r"\b((software|swe|sde|se|developer|engineer)\s*(ii|2))\b"
LEVEL_THREE = r"\b(iii|3)\b"
JUNIOR_POSITIVE = (
    r"\b(junior|new\s*grad|entry\s*level|entry-level|associate|software\s*engineer\s*i|software\s*engineer\s*1"
    r"|swe\s*[i1]|sde\s*[i1]|se\s*[i1]|level\s*1|l1|ic1|graduate\s*(program)?|university\s*grad(uate)?)\b"
)
YEARS_0_TO_3 = (
    r"(?:\b(?:0|1|2|3)(?:\s*[-–]\s*(?:1|2|3))?\s*(?:years?|yrs?)\s*(?:of\s*experience|exp|yoe)?\b"
    r"|\b(?:0|1|2|3)\s*\+\s*(?:years?|yrs?)\b"
    r"|\b(?:up\s*to|≤|<=)\s*3\s*(?:years?|yrs?)\b"
    r"|\b(?:zero|one|two|three)(?:\s*(?:to|[-–])\s*(?:one|two|three))?\s*(?:years?|yrs?)\b)"
)
DESC_4PLUS_YEARS = (
    r"\b((?:4|5|6|7|8|9|1[0-9])\s*(?:\+|plus)?\s*(?:years?|yrs?)\s*(?:of\s*experience|exp|yoe)?"
    r"|(?:at\s*least|min(?:imum)?\s*of|min\.?\s*)?(?:4|four)\s*(?:years?|yrs?)"
    r"|(?:4|four)\s*[-–]\s*(?:5|six|6|7|seven|8|eight|9|nine|1[0-9])\s*(?:years?|yrs?))\b"
)
DESC_SENIOR_WORDS = r"\b(senior|staff|principal|lead|architect|manager)\b"
JUNIOR_DESC_POSITIVES = (
    "junior", "new grad", "new college grad", "recent grad", "recent graduate", "recent college graduate",
    "fresh graduate", "entry level", "entry-level", "early career", "early in career", "college hire",
    "university graduate", "graduate role", "graduate program", "grad program", "apprentice", "apprenticeship",
    "apprenticeship programme", "intern to full-time", "engineer i", "developer i", "software engineer i",
    "level 1", "ic-1", "ic1", "l1", "0-1 years", "0–1 years", "0 to 1 years", "0-2 years", "0–2 years",
    "0 to 2 years", "1-2 years", "1–2 years", "1 to 2 years", "1-3 years", "1–3 years", "1 to 3 years",
    "0-2 years preferred", "0–2 years preferred", "0 to 2 years preferred", "0-3 years preferred",
    "0–3 years preferred", "0 to 3 years preferred", "up to 2 years", "up to 3 years", "under 3 years",
    "less than 3 years", "preferred 0-2 years", "preferred 0–2 years", "early talent", "early talent program",
    "campus hire", "new college graduate", "graduate scheme", "rotation program", "rotational program",
    "entry role", "engineer 1", "developer 1", "software engineer 1",
)

# ---- level inference -------------------------------------------------------------------

LEVEL_JUNIOR_TITLE = (
    "junior", "new grad", "entry level", "entry-level", "associate", "engineer i", "software engineer i",
    "swe i", "se i", "sde i", "level 1", " l1", " l-1", " i)", " i ",
)
LEVEL_JUNIOR_DESC = (
    "junior", "new grad", "recent grad", "entry level", "entry-level", "early career", "0-1 years", "0–1 years",
    "0 to 1 years", "0-2 years", "0–2 years", "0 to 2 years", "1-2 years", "1–2 years", "1 to 2 years",
)
LEVEL_SENIOR_TITLE = ("senior", "sr.", "sr ", " staff", "principal", "lead", "architect", " manager")
LEVEL_MID_TITLE = (
    "engineer ii", "software engineer ii", "swe ii", "se ii", "sde ii", "level 2", " l2", " l-2", " ii)", " ii ",
)

# ---- remote tests ----------------------------------------------------------------------

US_MARKERS = (
    "united states", "u.s.", "usa", "u.s.a", "us only", "remote - us", "remote (us)", "us-remote", "remote/us",
)
NON_US_MARKERS = (
    "canada", "canadian", "toronto", "vancouver", "montreal", "united kingdom", "uk", "europe", "eu", "emea",
    "apac", "australia", "new zealand", "nz", "mexico", "latam", "brazil", "argentina", "colombia", "chile",
    "peru", "india", "singapore", "philippines", "africa", "south africa", "nigeria", "mena", "uae", "dubai",
    "middle east", "germany", "france", "spain", "italy", "portugal", "netherlands", "belgium", "sweden",
    "norway", "denmark", "finland", "ireland", "poland", "romania",
)
BASIC_SENIOR_MARKERS = ("senior", "staff", "principal", "lead", "manager", "architect", "sr ")

# ---- curated lists ---------------------------------------------------------------------

CURATED_REMOTE_HINTS = (
    "remote", "us-remote", "us remote", "united states (remote)", "anywhere in the us", "usa (remote)", "remote, us",
)
CURATED_JUNIOR_HINTS = (
    "new grad", "new‑grad", "entry", "entry level", "entry-level", "level 1", "engineer i", "software engineer i",
    "associate", "university", "graduate program", "associate software engineer",
)
CURATED_UNWANTED_REGIONS = (
    "india", "emea", "apac", "europe only", "singapore", "china", "japan", "korea", "latam", "canada",
    "canada only", "europe",
)
CURATED_US_TOKENS = r"\b(us|u s|u s a|usa|united states)\b"
CURATED_US_PUNCTUATED = r"\(us\)|us-remote|remote-us|us only|us-based"
CURATED_DEFAULT_TITLE = "Software Engineer (New Grad)"
CURATED_DEFAULT_SOURCES = (
    "https://github.com/SimplifyJobs/New-Grad-Positions",
    "https://github.com/vanshb03/New-Grad-2026",
    "https://github.com/speedyapply/2026-SWE-College-Jobs/blob/main/NEW_GRAD_USA.md",
)
LIST_BRANCHES = ("main", "master")
LIST_FILES = ("README.md", "NEW_GRAD_USA.md", "US-NEW-GRAD.md")
LIST_COLUMNS = {
    "company": ("company", "organization", "employer"),
    "title": ("role", "position", "title"),
    "location": ("location", "locations"),
    "url": ("apply", "application", "link", "url", "posting"),
    "date": ("date", "posted", "posted on", "updated", "last update", "last updated"),
    "age": ("age", "ago"),
}
AGGREGATOR_HOST = "simplify.jobs"
AGGREGATOR_PREFIX = "https://simplify.jobs/"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"

# ---- earlier title and location rules --------------------------------------------------

STRICT_JUNIOR_TITLE = r"\b(junior|new\s*grad|entry\s*level|entry-level|software\s*engineer\s*i\b|associate\b)\b"
STRICT_SENIOR = r"\b(senior|sr\.?|staff|principal|lead|manager|director|head|vp|vice\s*president|chief)\b"
STRICT_NON_ENG = (
    r"\b(marketing|sales|account\b|account\s*executive|customer\b|success|care|operations|payroll|finance|legal"
    r"|counsel|attorney|recruit(er|ing)?|designer|architect|solutions|consultant|support|program\s*manager"
    r"|project\s*manager|product\s*marketing|enablement|coordinator|specialist|analyst)\b"
)
STRICT_MISFIT = r"\b(security|networking|rust)\b"
STRICT_ENGINEERING = (
    r"\b((software|full[-\s]*stack|fullstack|front[-\s]*end|frontend|back[-\s]*end|backend|platform|web|mobile"
    r"|ios|android|data|ml|devops)\s*(engineer|developer))\b"
)
COUNTRY_BLOCK = (
    r"\b(australia|austria|brazil|canada|chile|china|colombia|costa\s*rica|denmark|estonia|finland|france|germany"
    r"|iceland|india|indonesia|ireland|israel|italy|japan|latvia|lithuania|malaysia|mexico|netherlands"
    r"|new\s*zealand|norway|philippines|poland|portugal|romania|singapore|south\s*korea|spain|sweden"
    r"|switzerland|taiwan|thailand|turkey|uae|united\s*arab\s*emirates|united\s*kingdom|uk|england|scotland"
    r"|wales|ireland|vietnam|berlin|paris|london|toronto|vancouver|montreal|ottawa|amsterdam|madrid|barcelona"
    r"|reykjavik|warsaw)\b"
)
HYBRID_FLAG = r"\bhybrid\b"
REMOTE_FLAG = r"\bremote\b"
US_FLAG = r"\b(united\s*states|usa|u\.?s\.?)\b"
LOCATION_US_REMOTE = (
    r"\b(remote)\b.*\b(united\s*states|usa|u\.?s\.?)\b|\b(united\s*states|usa|u\.?s\.?)\b.*\b(remote)\b"
)
RELAX_PHRASES = r"\b(new\s*grad|recent\s*grad(uate)?|early\s*career|entry\s*level|junior)\b"
RELAX_YEAR_HINTS = (
    "0-1 year", "0-1 years", "0–1 years", "0 to 1 years", "0-2 years", "0–2 years", "0 to 2 years", "1-2 years",
    "1–2 years", "1 to 2 years", "1-3 years", "1–3 years", "1 to 3 years", "2-3 years", "2–3 years",
    "2 to 3 years", "up to 2 years", "less than 3 years", "maximum 2 years",
)

# ---- snippet budget order --------------------------------------------------------------

BUDGET_JUNIOR_BONUS = (
    r"\b(new\s*grad|junior|associate|engineer\s*[i1]\b|software\s*engineer\s*[i1]\b|swe\s*[i1]\b|sde\s*[i1]\b"
    r"|level\s*1\b|l1\b|university|graduate|grad)\b"
)
BUDGET_ML = r"\b(data\s*scientist|machine\s*learning|ml)\b"

# ---- dates -----------------------------------------------------------------------------

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TEXT_ISO_DATE = r"\b(20\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b"
TEXT_MONTH_DATE = (
    r"\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
    r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+([0-3]?\d)(?:,)?\s+(20\d{2})\b"
)
TEXT_POSTED_DAYS = r"posted\s+(?:about\s+)?(\d{1,2})\s+days?\s+ago"
TEXT_DAYS_AGO = r"\b(\d{1,2})\s+days?\s+ago\b"

# ---- keys, limits and default arguments ------------------------------------------------

EXTERNAL_ID_KEYS = (
    "external_id", "id", "job_id", "greenhouse_id", "gh_id", "lever_id", "workday_id", "ashby_id", "workable_id",
)
CSV_COLUMNS = (
    "rank", "company", "title", "location", "source", "provider", "company_token", "level", "posted_at",
    "posted_days_ago", "skill_score", "company_priority", "url",
)
DEFAULT_SKILLS = (
    "python", "react", "typescript", "javascript", "node", "postgres", "sql", "fastapi", "api", "restful api",
    "rest api", "aws",
)
SNIPPET_CHARS = 1200
SNIPPET_CAP = 30
JUNIOR_TOP_UP_CAP = 150
DATE_BACKFILL_CAP = 120
RETENTION_DAYS = 30
SAMPLE_SIZE = 10
PAGE_LIMIT = 25
PAGE_LIMIT_MAX = 100
ORDERS = ("id_desc", "id_asc", "posted_at_desc", "posted_at_asc")
DEFAULT_ORDER = "posted_at_desc"

# ---- objects that point to a posting ---------------------------------------------------
# Keys under which they name its address, title and date; the first that is filled counts.
POSTING_LINK_KEYS = ("jobPostingUrl", "jobPostUrl", "url", "jobUrl")
POSTING_TITLE_KEYS = ("title", "jobTitle")
POSTING_DATE_KEYS = ("publishedAt", "updatedAt")
