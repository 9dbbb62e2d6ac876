"""Fixed values.

Word lists, lookup tables, thresholds, patterns and message texts that results
depend on.  They are data, not logic: change one and a score or an extracted
field changes with it.  The skill catalogue is *not* here, it is a table the
caller passes in (``operators.catalogue``).
"""

# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------
COMPONENTS = (
    "required_skills",
    "experience",
    "education",
    "preferred_skills",
    "semantic",
    "certifications",
)
DEFAULT_WEIGHTS = {
    "required_skills": 0.40,
    "experience": 0.20,
    "education": 0.15,
    "preferred_skills": 0.10,
    "semantic": 0.10,
    "certifications": 0.05,
}
WEIGHT_TOLERANCE = 1e-3
SEMANTIC_SKILL_THRESHOLD = 0.45
SEMANTIC_PARTIAL_CREDIT = 0.55
WEAK_CONFIDENCE = 0.55
SEMANTIC_CEILING = 0.85
TEXTUAL_CERTIFICATION_CONFIDENCE = 0.9
EDUCATION_STEP = 0.4

SORT_COLUMNS = {
    "overall": "overall_score",
    "required_skills": "required_skills_score",
    "experience": "experience_score",
    "education": "education_score",
    "preferred_skills": "preferred_skills_score",
    "semantic": "semantic_score",
    "certifications": "certifications_score",
}
SCORE_BANDS = ((0.85, "excellent"), (0.7, "strong"), (0.55, "moderate"), (0.4, "weak"))
LOWEST_BAND = "poor"
SCORE_TONES = ((0.85, "excellent"), (0.7, "good"), (0.5, "fair"))
LOWEST_TONE = "poor"
SCORE_BUCKETS = (
    ("0-20", 0.0, 0.2),
    ("20-40", 0.2, 0.4),
    ("40-60", 0.4, 0.6),
    ("60-80", 0.6, 0.8),
    ("80-100", 0.8, 1.0001),
)
AGE_BANDS = ((0, 25, "under 25"), (25, 32, "25-31"), (32, 40, "32-39"), (40, 200, "40+"))
COMPONENT_LABELS = {
    "required_skills": "Required skills",
    "experience": "Experience",
    "education": "Education",
    "preferred_skills": "Preferred skills",
    "semantic": "Semantic similarity",
    "certifications": "Certifications",
}

# --------------------------------------------------------------------------
# Message texts stored beside a score
# --------------------------------------------------------------------------
NOTE_EDUCATION = "Education could not be evaluated: the candidate's qualification was not detected."
NOTE_SEMANTIC = "Semantic similarity was unavailable for this comparison."
NOTE_REQUIRED = "This job lists no required skills, so required-skill scoring was skipped."
NOTE_FALLBACK = "No scoring signal was applicable; the score reflects document similarity only."
NOTE_RENORMALISED = (
    "Components not applicable to this job were excluded and the remaining "
    "weights renormalised: "
)
NOTE_WEAK = (
    "Weak signals are semantic or low-confidence matches. Confirm them with the "
    "candidate before treating them as skills."
)
NOTE_MISSING = (
    "Missing requirements may still be present but phrased differently; review the "
    "original resume."
)
CERTIFICATION_EVIDENCE = "Listed in the candidate's certifications"
SCREENING_DISCLAIMER = (
    "Screening aid only. This score is generated from resume text and job "
    "requirements and must not be treated as a hiring decision."
)

# --------------------------------------------------------------------------
# Degrees and education
# --------------------------------------------------------------------------
DEGREE_TOKENS = (
    ("doctor of philosophy", 6), ("ph d", 6), ("phd", 6), ("doctorate", 6), ("doctoral", 6),
    ("doctor of engineering", 6), ("dphil", 6),
    ("master of science", 5), ("master of engineering", 5), ("master of arts", 5),
    ("master of business administration", 5), ("masters", 5), ("master", 5), ("msc", 5),
    ("ms", 5), ("mba", 5), ("meng", 5), ("mtech", 5), ("mca", 5), ("ma", 5), ("m sc", 5),
    ("bachelor of science", 4), ("bachelor of engineering", 4), ("bachelor of technology", 4),
    ("bachelor of arts", 4), ("bachelor", 4), ("bachelors", 4), ("bsc", 4), ("bs", 4), ("be", 4),
    ("btech", 4), ("bca", 4), ("b eng", 4), ("b sc", 4), ("b tech", 4),
    ("associate", 3), ("diploma", 2), ("certificate", 1), ("high school", 1), ("secondary", 1),
    ("intermediate", 2), ("fsc", 2), ("hsc", 2), ("ssc", 1), ("matric", 1),
)
REQUIREMENT_TOKENS = (
    ("phd", 6), ("doctorate", 6), ("doctoral", 6),
    ("master", 5), ("msc", 5), ("ms", 5), ("mba", 5), ("m tech", 5), ("mtech", 5), ("meng", 5),
    ("mca", 5),
    ("bachelor", 4), ("bsc", 4), ("bs", 4), ("b tech", 4), ("btech", 4), ("bca", 4), ("b e", 4),
    ("be", 4),
    ("associate", 3), ("diploma", 2), ("high school", 1), ("secondary", 1),
)
DEGREE_LABELS = {
    1: "Secondary", 2: "Diploma", 3: "Associate", 4: "Bachelor's", 5: "Master's", 6: "Doctorate",
}
STUDY_FIELDS = (
    "computer science", "software engineering", "computer engineering", "information technology",
    "artificial intelligence", "machine learning", "data science", "statistics", "mathematics",
    "electronics", "electrical engineering", "mechanical engineering", "civil engineering",
    "business administration", "management sciences", "finance", "accounting", "marketing",
    "psychology", "sociology", "biology", "chemistry", "physics", "economics",
)
INSTITUTION_HINTS = (
    "university", "universidad", "college", "institute", "institut", "school", "academy",
    "polytechnic", "campus", "faculty", "dept of", "department of",
)
LEADING_DEGREE = (
    r"(?i)^(?:bachelor|master|ph\.?d\.?|doctorate|msc|bsc|b\.?s\.?|m\.?s\.?|mba|btech|bca)\b"
    r"[^,]*,\s*"
)
TRAILING_YEAR = r"[,\s(\[]*\b(?:19|20)\d{2}\b[\s)\]]*\s*$"
FOUR_DIGIT_YEAR = r"\b((?:19|20)\d{2})\b"

# --------------------------------------------------------------------------
# Months and date ranges
# --------------------------------------------------------------------------
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
FIRST_YEAR = 1970
TWO_DIGIT_PIVOT = 70
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_PRESENT = r"present|current|curr(?:ent)?|now|today|to\s+date|ongoing|continuing"
_YEAR4 = r"(?:19|20)\d{2}"
#: Part of every notation below.
RANGE_SEPARATOR = r"(?i)\d\s*(?:[-–—]|to|until|till|through|thru)"
RANGE_MONTH_YEAR = (
    rf"(?i)\b({_MONTH})[\s.,]*'?(\d{{2,4}})\b\s*(?:-|–|—|to|until|till|through|thru)\s*"
    rf"(?:({_MONTH})[\s.,]*'?(\d{{2,4}})\b|({_PRESENT}))"
)
RANGE_MONTH_YEAR_TO_YEAR = (
    rf"(?i)\b({_MONTH})[\s.,]*'?(\d{{2,4}})\b\s*(?:-|–|—|to|until|till)\s*({_YEAR4})\b"
)
# Corrected: months 10 to 12 are read whole.
RANGE_YEAR_MONTH = (
    rf"(?i)\b({_YEAR4})\s*[/\-.]\s*(1[0-2]|0?[1-9])(?!\d)\s*(?:-|–|—|to|until|till)\s*"
    rf"(?:({_YEAR4})\s*[/\-.]\s*(1[0-2]|0?[1-9])(?!\d)|({_PRESENT}))"
)
RANGE_YEARS = rf"\b({_YEAR4})\s*(?:-|–|—|to|until|till)\s*({_YEAR4})\b"
RANGE_YEAR_PRESENT = (
    rf"(?i)\b({_YEAR4})\s*(?:-|–|—|to|until|till|thru|through)\s*({_PRESENT})\b"
)
RANGE_NUMBER_YEAR = (
    rf"(?i)\b(0?[1-9]|[12]\d|3[01])\s*[/\-.]\s*({_YEAR4})\s*(?:-|–|—|to|until|till)\s*"
    rf"(?:(0?[1-9]|[12]\d|3[01])\s*[/\-.]\s*({_YEAR4})|({_PRESENT}))"
)
ROLE_MARKERS = (
    " at ", " @ ", " engineer", " developer", " scientist", " analyst", " manager",
    " designer", " architect", " consultant", " specialist", " lead", " intern",
    " professor", " researcher", " associate", " technician", " officer",
)
RELEVANT_TITLE_WORDS = (
    "engineer", "developer", "scientist", "analyst", "architect", "data", "machine learning",
    "ai", "ml", "research", "software", "programmer", "consultant", "automation",
)
TECHNICAL_TEXT_WORDS = ("engineer", "developer", "data", "analyst", "scientist")
COMPANY_SEPARATORS = (" at ", " @ ", " - ", " | ", ", ", " for ")
ANY_CASE_SEPARATORS = (" at ", " @ ")

# --------------------------------------------------------------------------
# cleaning
# --------------------------------------------------------------------------
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl",
    "\ufb05": "st", "\ufb06": "st",
}
ZERO_WIDTH = "\u200b\ufeff\u00ad"
LEADING_BULLET = (
    "^[\\s\u00a0]*[\u2022\u25cf\u25aa\u25e6\u2043\u2219\u00b7\\-\u2013\u2014>*]+[\\s\u00a0]*"
)
LIST_MARKER = "^\\s*(?:[-*\u2022\u25cf\u25aa\u2013\u2014>]+|\\d+[.)])\\s*"
HYPHEN_BREAK = "(?U)(\\w)[-\u2010\u2011\u2012\u2013]\\n(\\w)"
PAGE_NOISE = r"(?i)^(?:page\s+)?\d+\s*(?:of\s*\d+)?\.?$"
URL_LINE = r"(?i)^https?://\S+$"
EMAIL_LINE = r"^\S+@\S+$"
CONTACT_PART = r"^(?:[\w.+-]+@[\w.-]+|(?:\+?\d[\d\s().-]{7,}\d)|(?:https?://|www\.)\S+)$"
CONTACT_SPLIT = "\\s*[|\u2022\u00b7]\\s*|\\s{3,}"
RUNNING_HEADER_HINT = r"(?i)(?:curriculum\s*vitae|résumé|resume\s+of|page\s+\d+|confidential)"
#: Runs of white space but for a single space, which stays as it is.
HORIZONTAL_SPACE = r"[\t\x0b\f\r][ \t\x0b\f\r]*| [ \t\x0b\f\r]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
SENTENCE_EDGE = " -*\u2022\t"
MIN_SENTENCE = 25

# --------------------------------------------------------------------------
# Resume sections
# --------------------------------------------------------------------------
SECTION_ALIASES = {
    "summary": ("summary", "professional summary", "profile", "objective", "about me",
                "personal statement"),
    "skills": ("skills", "technical skills", "core skills", "key skills", "skills and tools",
               "technologies", "tech stack", "competencies", "expertise", "areas of expertise"),
    "experience": ("experience", "work experience", "professional experience",
                   "employment history", "career history", "work history",
                   "professional background", "relevant experience"),
    "projects": ("projects", "personal projects", "academic projects", "selected projects",
                 "research projects", "portfolio"),
    "education": ("education", "academic background", "academic qualifications",
                  "educational background", "education and training", "qualifications",
                  "academic credentials"),
    "certifications": ("certifications", "certification", "licenses and certifications",
                       "licenses", "courses", "training", "professional development"),
    "achievements": ("achievements", "awards", "accomplishments", "honors and awards",
                     "publications"),
    "languages": ("languages", "language proficiency", "spoken languages"),
    "interests": ("interests", "hobbies", "activities", "extracurricular"),
    "contact": ("contact", "contact information", "contact details", "personal details"),
    "references": ("references", "referees"),
}
INLINE_SECTION = "skills"
#: Lines of the header area, where a name and a place are looked for first.
NAME_LINES = 6
LOCATION_LINES = 12
HEADING_MAX_CHARS = 80
HEADING_MAX_WORDS = 6
LABEL_WITH_CONTENT = r"^\s*([A-Za-z][A-Za-z &/,'()\-\.]{1,60}?)\s*:\s*(\S.*)$"
LABEL_ONLY = r"^\s*([A-Za-z][A-Za-z &/,'()\-\.]{1,60}?)\s*:\s*$"
PROFILE_SECTIONS = (
    "summary", "experience", "skills", "projects", "education", "certifications", "achievements",
)

# --------------------------------------------------------------------------
# Contact details
# --------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
PHONE = (
    r"(?<![\w.])(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{3}[\s.-]?\d{3,4}"
    r"(?:[\s.-]?\d{2,4})?(?![\w.])"
)
LINKEDIN = r"(?i)linkedin\.com/[\w\-/%.]+"
GITHUB = r"(?i)github\.com/[\w\-]+"
URL_TOKEN = r"(?i)(?:https?://|www\.)?[\w\-]+(?:\.[\w\-]+)+(?:/[\w\-/?%&=+#.~]*)?"
NON_PORTFOLIO_HOSTS = (
    "linkedin.com", "github.com", "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com",
    "outlook.com", "icloud.com", "proton.me", "protonmail.com",
)
ROLE_WORDS = (
    "resume", "curriculum vitae", "cv", "engineer", "developer", "scientist", "analyst",
    "manager", "consultant", "designer", "architect", "intern", "student", "graduate",
    "summary", "profile", "contact", "experience", "education", "skills", "projects",
    "certifications", "objective",
)
NAME_TOKEN = r"^[A-Za-z][A-Za-z'\-]{1,29}$"
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "mba", "msc", "bs", "bsc")
NAME_LABEL = r"(?i)^(?:name|candidate|full name)\s*[:\-]\s*(.+)$"
CITY_COUNTRY = (
    r"\b([A-Z][a-zA-Z.'\-]{2,30}(?:\s+[A-Z][a-zA-Z.'\-]{2,30})?)\s*,\s*"
    r"([A-Z][a-zA-Z.'\-]{2,30}(?:\s+[A-Z][a-zA-Z.'\-]{2,30})?)\b"
)
COUNTRY = (
    r"(?i)\b(USA|U\.S\.A\.|United States|Pakistan|India|UK|United Kingdom|Canada|Australia|Germany|"
    r"France|UAE|Saudi Arabia|Singapore|Netherlands|Spain|Italy|Brazil|Mexico|China|Japan|Kenya|"
    r"Nigeria|Egypt|Bangladesh|Ireland|Poland|Portugal|Sweden|Norway|Denmark|Finland|Switzerland|"
    r"Belgium)\b"
)
LABEL_LINE = r"^[A-Za-z][A-Za-z &/]{1,30}\s*:\s*\S"
TITLE_LABELS = (
    r"(?i)^(?:current|present)\s+(?:title|role|position)\s*[:\-]\s*(.+)$",
    r"(?i)^(?:job\s+)?title\s*[:\-]\s*(.+)$",
)
TITLE_SEPARATOR = (
    r"(?U)^([A-Za-z][\w\s\-+#/\.]+?)[ \t]*(?:,|\||@|\bat\b)[ \t]*([A-Z][\w\s\.&-]*)"
)
TITLE_HINTS = (
    "engineer", "developer", "scientist", "analyst", "manager", "consultant", "designer",
    "architect", "specialist", "lead", "head", "director", "officer", "professor", "researcher",
    "associate", "intern", "administrator", "coordinator", "technician", "supervisor",
    "executive", "founder", "owner", "freelance",
)
WARN_NAME = "Candidate name could not be detected; please review the profile."
WARN_EMAIL = "No email address found in the resume."
WARN_SECTIONS = "No standard sections were detected; extraction quality may be reduced."
WARN_SKILLS = "No skills were detected in this resume."
WARN_DATES = "Employment dates could not be parsed; please verify total experience."

# --------------------------------------------------------------------------
# Skills and certifications in text
# --------------------------------------------------------------------------
SKILL_SPLIT = "[,;|\u2022\u00b7/]|\\s{2,}|\\s+\\+\\s+"
SKILL_YEARS = r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?|yr)"
PROFICIENCY_NOTE = (
    r"(?i)\((?:beginner|intermediate|advanced|expert|basic|proficient|fluent)[^)]*\)"
)
CHUNK_SPLIT = r"(?<=[a-z0-9)\]])\s*[|]\s*"
SKILL_STOPWORDS = r"\b(?:and|or|with|the|for)\b"
NOISE_SKILL = r"^(?:experience|knowledge|skills?|familiarity|proficiency|expertise|etc)$"
EXPLICIT_CONFIDENCE = 0.95
PHRASE_CONFIDENCE = 0.7
WORD_CONFIDENCE = 0.6
CERTIFICATION_PATTERNS = (
    r"(?i)\b((?:aws|azure|google cloud|gcp|databricks|tensorflow|microsoft|cisco|huawei|oracle|"
    r"salesforce)[^,;|\n]{0,60}?(?:certified|certification|certificate|cert)\w*)",
    r"\b([A-Z][A-Za-z0-9&/\.\- ]{2,60}?[ \t]+(?:Certified|Certification|Certificate)\w*)",
    r"(?i)\b((?:Certified[ \t]+)?(?:scrum[ \t]?master|csm|pmp|cissp|ccna|cfa|istqb|cka|ckad|"
    r"tf dev)[\w \t\-]{0,30})",
)
CERTIFICATION_MARKERS = (
    "certified", "certification", "certificate", "licensed", "license", "credential",
    "associate", "professional", "diploma",
)
SKILL_CATEGORIES = (
    "programming_language", "framework", "database", "cloud", "ai_ml", "devops", "data_science",
    "frontend", "mobile", "testing", "soft_skill", "certification", "other",
)

# --------------------------------------------------------------------------
# Job descriptions
# --------------------------------------------------------------------------
JOB_HEADINGS = (
    ("preferred_skills", (
        "preferred", "nice to have", "nice to have skills", "plus", "desirable", "bonus",
        "preferred qualifications", "extra credit", "good to have", "advantageous")),
    ("certifications", ("certifications", "certificates", "licenses", "credentials")),
    ("soft_skills", ("soft skills", "competencies", "personal attributes", "interpersonal",
                     "culture")),
    ("responsibilities", (
        "responsibilities", "what you will do", "the role", "duties", "about the role",
        "key responsibilities", "your impact", "day to day", "day-to-day", "what you'll do")),
    ("required_skills", (
        "requirements", "required", "minimum qualifications", "minimum requirements", "must have",
        "must have skills", "essential", "basic qualifications", "skills required",
        "what you need", "you have", "qualifications")),
)
JOB_SPLIT = "[,;|\u2022\u00b7]|\\s{2,}"
TRAILING_QUALIFIER = (
    r"(?i)\s*\((?:required|must(?:\s+have)?|mandatory|essential|preferred|nice\s+to\s+have|"
    r"desirable|bonus|plus|optional|strong|good\s+to\s+have)\)\s*$"
)
CONJUNCTION = r"(?i)\s+(?:and|or|/|,)\s+"
NOT_A_SKILL = (
    r"(?i)\b(?:years?|months?|degree|degrees|bachelor|master|phd|doctrine|diploma|university|"
    r"college|salary|range|per annum|usd|pkr|eur|apply|email|cv|resume|contact|interview|"
    r"availability|immediately|notice period|work authorization|visa|relocation)\b"
)
EXPERIENCE_BULLET = r"(?i)^\d+\s*\+?\s*(?:-\s*\d+\s*)?(?:years?|months?)"
EXPERIENCE_YEARS = (
    r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:-|\s)?\s*years?",
    r"(?i)(?:at\s+least|minimum(?:\s+of)?|min\.?)\s*(\d{1,2}(?:\.\d)?)\s*years?",
    r"(?i)(\d{1,2})\s*years?",
)
EXPERIENCE_SPAN = r"(?i)(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s*years?"
PREFERRED_MARKERS = ("preferred", "nice to have", "bonus", "plus", "desirable")
REQUIRED_MARKERS = ("required", "must have", "essential", "mandatory")
JOB_TITLE_SUFFIXES = ("job description", "job posting", "position", "role", "jd")
JOB_TITLE_SUFFIX = r"(?i)\s*(?:job description|job posting|position|role|jd)\s*$"
JOB_TITLE_HINTS = ("engineer", "developer", "scientist", "analyst", "manager", "designer", "lead",
                   "intern")
DEPARTMENT_LABEL = r"(?i)^(?:department|team|division|function)\s*[:\-]\s*(.+)$"
LOCATION_LABEL = r"(?i)^(?:location|based in|office|work location)\s*[:\-]\s*(.+)$"
LOCATION_HINTS = ("location", "based in", "office", "work from", "on-site", "onsite", "hybrid",
                  "remote", "relocation", "commute")
EMPLOYMENT_TYPES = (
    "full-time", "full time", "part-time", "part time", "contract", "contractor", "temporary",
    "internship", "intern", "freelance", "remote", "hybrid", "on-site", "onsite",
)
EDUCATION_WORDS = ("degree", "education", "qualification", "bachelor", "master", "phd", "diploma")
EDUCATION_PHRASE = (
    r"(?i)(bachelor(?:'s)?|master(?:'s)?|ph\.?d|doctorate|mba|b\.?sc|m\.?sc|b\.?tech|m\.?tech)"
    r"[^,\n]{0,60}"
)
WARN_NO_REQUIRED = "No required skills were detected. Please review and add them manually."
WARN_NO_EXPERIENCE = "Experience requirement was not detected; please set it manually."

# --------------------------------------------------------------------------
# questions
# --------------------------------------------------------------------------
INTENTS = (
    ("top_candidates", r"(?i)\btop\b|\bbest\s+match|\bhighest\s+match|\brank(?:ed|ing)?\b"),
    ("missing_skills",
     r"(?i)\bmissing\b|\black(?:s|ing)?\b|\bdon'?t have\b|\bwithout\b|\bgap\b"),
    ("shortlist", r"(?i)\bshortlist|\bshortlisted\b"),
    ("compare", r"(?i)\bcompare\b|\bversus\b|\bvs\.?\b|\bdifference\b"),
    ("candidate_detail", r"(?i)\bwho is\b|\bprofile\b|\bresume\b|\bcandidate\b"),
    ("job_summary", r"(?i)\bjob\b|\brole\b|\bposition\b|\brequirement"),
    ("counts", r"(?i)\bhow many\b|\bcount\b|\bnumber of\b|\btotal\b"),
)
SORT_HINTS = (
    ("required_skills", r"(?i)\bskill"),
    ("experience", r"(?i)\bexperien"),
    ("education", r"(?i)\beducat|degree"),
    ("semantic", r"(?i)\bsemantic|similar|relevan"),
    ("certifications", r"(?i)\bcertif"),
)
NAME_MARKERS = ("compare ", "compare between ", "difference between ", " vs ")
NAME_SPLIT = r"\s*(?:,|\band\b|\bversus\b|\bvs\.?\b)\s*"
QUOTED_NAME = "[\"']([^\"']{2,60})[\"']"
TRANSCRIPT_KEEP = 40

# --------------------------------------------------------------------------
# Privacy, storage, display
# --------------------------------------------------------------------------
PII_URL = r"https?://\S+|www\.\S+"
PII_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PII_PHONE = (
    r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?"
)
SECRET_KEYS = ("password", "token", "secret", "api_key", "access_token", "refresh_token")
EMAIL_KEYS = ("email", "candidate_email")
ERASED_NAME = "Deleted candidate"
ERASED_REASON = "Deleted at the candidate's or administrator's request"
UPLOAD_EXTENSIONS = (".pdf", ".docx", ".txt")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
#: Windows-1252 characters of the bytes that ISO-8859-1 reads as controls; five have none.
C1_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
C1_WINDOWS = "".join(bytes([ord(c)]).decode("cp1252") for c in C1_CONTROLS)
#: First bytes of PDF, ZIP (DOCX) and OLE (DOC) files.
BINARY_HEADS = ("25504446", "504B0304", "D0CF11E0")
MAX_UPLOAD_FILES = 20
MIN_DOCUMENT_CHARS = 40
RETENTION_DAYS = 365
RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60
ACRONYMS = {
    "ai": "AI", "ml": "ML", "dl": "DL", "nlp": "NLP", "llm": "LLM", "llms": "LLMs", "api": "API",
    "apis": "APIs", "sql": "SQL", "aws": "AWS", "gcp": "GCP", "ui": "UI", "ux": "UX", "qa": "QA",
    "hr": "HR", "bi": "BI", "etl": "ETL", "ci": "CI", "cd": "CD", "os": "OS", "db": "DB",
    "js": "JS", "ts": "TS", "c": "C", "r": "R", "go": "Go", "k8s": "K8s", "gpu": "GPU",
    "nn": "NN", "pr": "PR", "vc": "VC",
}

# --------------------------------------------------------------------------
# Vectors, features, evaluation
# --------------------------------------------------------------------------
EMBEDDING_DIMENSIONS = 384
MIN_DIMENSIONS = 64
FEATURES = (
    "required_skills_score", "experience_score", "education_score", "preferred_skills_score",
    "semantic_score", "certifications_score", "overall_score", "matched_required_ratio",
    "weak_required_ratio", "missing_required_ratio", "matched_preferred_ratio",
    "matched_certifications", "matched_required_count", "missing_required_count",
    "experience_gap_years", "experience_overqualified", "degree_gap_levels", "tfidf_cosine",
    "hashed_cosine", "active_weight", "applicable_components", "candidate_text_length",
    "job_required_count", "same_role_family",
)
PROTECTED = ("gender", "birth_year")
RELEVANCE_THRESHOLD = 2
CV_FOLDS = 5
MIN_SUBGROUP_ROWS = 30
MIN_SUBGROUP_JOBS = 3
