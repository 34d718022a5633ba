"""Regular expressions and word lists that results depend on."""

#: Entity patterns (Java syntax; Unicode digits and blanks by (?U)).
PROTOCOL = r"(?iU)\b[A-Za-z]?mRNA[- ]?\d{4}[- ]?P\d{3}\b"
DATE = r"(?U)\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b"
POSTAL = r"(?U)\b\d{5}(?:-\d{4})?\b"
NCT = r"(?iU)\bNCT\d{8}\b"
PERSON = r"(?U)\b[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3}(?:,?\s*(?:MD|DO|PhD))?\b"
#: Two title-case words, then perhaps a sign and a degree.
PERSON_RULE = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}*\s+\p{Lu}\p{Ll}*(?![\p{L}\p{N}])(?:\s*\p{Punct})?(?:\s*(?i:md|do|phd)(?![\p{L}\p{N}]))?"

#: Detectors for types that the policy names.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]"
PHONE = r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}"
ASCII_PERSON = r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+"

#: Entity types by parts of a field's name.
FIELD_TYPES = [
    ("PERSON", ["invest_name", "sub_inv_names", "invesname", "appname", "invname"]),
    ("ADDRESS", ["address", "_city", "_state", "_country", "_zip"]),
    ("SENSITIVE_FACILITY", ["loc_name", "lab_name", "irb_name"]),
    ("DATE", ["sigdate", "sig_date"]),
    ("CCI_STUDY_TITLE", ["prot_name_code", "nameofstudy"]),
    ("CCI_SPONSOR", ["appfirm"]),
]

#: Titles of forms, upper case, any of which names the form.
FORMS = [
    ("FDA_1572", [r"FORM\s+FDA\s+1572", r"STATEMENT\s+OF\s+INVESTIGATOR"]),
    ("FDA_3454", [r"FORM\s+FDA\s+3454", r"CERTIFICATION.{0,80}FINANCIAL\s+INTERESTS"]),
    ("FDA_3455", [r"FORM\s+FDA\s+3455", r"DISCLOSURE.{0,80}FINANCIAL\s+INTERESTS"]),
]

#: Words of tables and of protocols, upper case.
TABLE_LANGUAGE = r"\bTABLE\b|SCHEDULE\s+OF\s+EVENTS|GRADE\s+[0-4]|TREATMENT\s+GROUP|ENDPOINT"
PROTOCOL_LANGUAGE = r"\bPROTOCOL\b|CLINICAL\s+STUDY|MODERNATX"

#: Labels of a protocol's cover page.
COVER = [
    ("nct_id", r"(?i)NCT\s*#?\s*:?\s*(NCT[0-9O]{8})"),
    ("protocol_number", r"(?i)Protocol\s+Number\s*:\s*([A-Za-z0-9-]+)"),
    ("sponsor_name", r"(?i)Sponsor\s+Name\s*:\s*(.+?)(?=Legal\s+Registered\s+Address)"),
    ("sponsor_address", r"(?i)Legal\s+Registered\s+Address\s*:\s*(.+?)(?=Sponsor\s+Contact|Medical\s+Monitor)"),
    ("amendment_number", r"(?i)Amendment\s+Number\s*:\s*(\d+)"),
]
COVER_TITLE = r"(?i)Protocol\s+Title\s*:\s*(.+?)(?=Protocol\s+Number\s*:)"
COVER_PHASE = r"(?i)\bPhase\s+([0-9]+(?:\s*/\s*[0-9]+)?)"
#: The date of an amendment: of any, and of the one whose number goes between both parts.
AMENDMENT_DATE = r"(?i)Date\s+of\s+Amendment\s+", r"\s*:?\s*(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})"
#: A town whose postal address is put in one spelling, and a sponsor by normalised name.
TOWN, TOWN_AS = r"(?i)\bCambridge\s*,?\s*MA\s*(\d{5})\b", r"Cambridge, MA $1"
SPONSOR, SPONSOR_AS = "modernatx", "ModernaTX, Inc."

#: Statuses of jobs.
JOB_STATUSES = ["queued", "retrying", "preprocessing", "classifying", "extracting", "redacting", "persisting", "completed", "needs_review", "failed"]
ACTIVE = ["preprocessing", "classifying", "extracting", "redacting", "persisting"]
TERMINAL = ["completed", "needs_review", "failed"]
SUCCESS = ["completed", "needs_review"]

#: Upper bounds of request times in seconds.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 15, 30]
