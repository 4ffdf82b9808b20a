"""Fixed values of detection, suppression and normalisation. They must be these for results to be right."""

# entity type, expression, score, region, framework
PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0.85, "GLOBAL", "GDPR/CCPA/PIPEDA"),
    ("PHONE_INTL", r"\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{1,4}[\s\-]?\d{1,9}", 0.75, "GLOBAL", "GLOBAL"),
    ("CREDIT_CARD", r"\b(?:\d[ \-]?){13,18}\d\b", 0.80, "GLOBAL", "PCI-DSS"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", 0.85, "GLOBAL", "GDPR/PCI-DSS"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.80, "GLOBAL", "GDPR/CCPA"),
    ("IPV6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.80, "GLOBAL", "GDPR/CCPA"),
    ("DATE_OF_BIRTH_DMY", r"\b(?:0?[1-9]|[12]\d|3[01])/(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}\b", 0.70, "GLOBAL", "GDPR/CCPA/PIPEDA"),
    ("DATE_OF_BIRTH_MDY", r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b", 0.70, "GLOBAL", "GDPR/CCPA/PIPEDA"),
    ("DATE_OF_BIRTH_ISO", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0.70, "GLOBAL", "GDPR/CCPA/PIPEDA"),
    ("GPS_COORDINATES", r"\b-?(?:[1-8]?\d(?:\.\d+)?|90(?:\.0+)?),\s*-?(?:1[0-7]\d(?:\.\d+)?|[1-9]?\d(?:\.\d+)?|180(?:\.0+)?)\b", 0.75, "GLOBAL", "GDPR/CCPA"),
    ("PASSPORT_ICAO", r"\b[A-Z]{1,2}[0-9]{6,9}\b", 0.70, "GLOBAL", "GLOBAL"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.90, "US", "HIPAA/CCPA"),
    ("SSN_NODASH", r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b", 0.60, "US", "HIPAA/CCPA"),
    ("PHONE_US", r"(?<!\w)(?:1[\s\-.])?(?:\(\d{3}\)|\d{3})[\s\-.]?\d{3}[\s\-.]?\d{4}(?!\w)", 0.80, "US", "TCPA/CCPA"),
    ("DRIVER_LICENSE_US", r"\b(?:[A-Z]{1,2}\d{6,8}|\d{7,9})\b", 0.65, "US", "DPPA/CCPA"),
    ("EIN", r"\b\d{2}-\d{7}\b", 0.80, "US", "IRS/CCPA"),
    ("BANK_ROUTING_US", r"\b(?:0[0-9]|1[0-2]|2[1-9]|3[0-2])\d{7}\b", 0.75, "US", "GLBA"),
    ("MEDICARE_BENEFICIARY_ID", r"\b[1-9][A-Z][A-Z0-9]\d[A-Z][A-Z0-9]\d[A-Z]{2}\d{2}\b", 0.85, "US", "HIPAA"),
    ("AADHAAR", r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.85, "IN", "DPDP/IT-Act"),
    ("PAN", r"\b[A-Z]{3}[ABCFGHLJPTF][A-Z]\d{4}[A-Z]\b", 0.95, "IN", "IT-Act/DPDP"),
    ("PASSPORT_IN", r"\b[A-Z][1-9]\d{6}\b", 0.80, "IN", "DPDP"),
    ("MOBILE_IN", r"\b(?:\+91[\s\-]?)?[6-9]\d{9}\b", 0.85, "IN", "DPDP/TRAI"),
    ("VOTER_ID_IN", r"\b[A-Z]{3}\d{7}\b", 0.75, "IN", "DPDP"),
    ("DRIVER_LICENSE_IN", r"\b[A-Z]{2}\d{2}\s?\d{11}\b", 0.75, "IN", "DPDP"),
    ("GST_NUMBER", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b", 0.90, "IN", "GST-Act"),
    ("NATIONAL_INSURANCE_UK", r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}\d{6}[ABCD]\b", 0.95, "UK", "UK-GDPR"),
    ("NHS_NUMBER", r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b", 0.70, "UK", "UK-GDPR/DSPT"),
    ("PASSPORT_UK", r"\b\d{9}\b", 0.60, "UK", "UK-GDPR"),
    ("SORT_CODE_UK", r"\b\d{2}-\d{2}-\d{2}\b", 0.75, "UK", "UK-GDPR/PSD2"),
    ("COMPANY_NUMBER_UK", r"\b(?:(?:OC|NI|SC|NL|LP|IP|SP|RS|FC|GE|GS|IC|CE|CS|AC|SA|NA|SL)\d{6,8}|\d{8})\b", 0.70, "UK", "UK-GDPR"),
    ("VAT_EU", r"\b[A-Z]{2}\d[\dA-Z]{6,11}\b", 0.75, "EU", "GDPR/VAT-Directive"),
    ("NATIONAL_ID_DE", r"\b[LMNPRTVWXY][A-Z0-9]{3}\d{5}[A-Z0-9]\b", 0.85, "EU", "GDPR/BDSG"),
    ("INSEE_FR", r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", 0.85, "EU", "GDPR/CNIL"),
    ("DNI_NIE_ES", r"\b(?:\d{8}[A-HJ-NP-TV-Z]|[XYZ]\d{7}[A-HJ-NP-TV-Z])\b", 0.90, "EU", "GDPR/LOPDGDD"),
    ("CODICE_FISCALE_IT", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", 0.90, "EU", "GDPR/Codice-Privacy"),
    ("SIN_CA", r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}\b", 0.80, "CA", "PIPEDA"),
    ("PASSPORT_CA", r"\b[A-Z]{2}\d{6}\b", 0.80, "CA", "PIPEDA"),
    ("HEALTH_CARD_CA", r"\b\d{10}\b", 0.60, "CA", "PHIPA/PIPEDA"),
    ("TAX_FILE_NUMBER_AU", r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{2,3}\b", 0.75, "AU", "Privacy-Act-AU"),
    ("MEDICARE_AU", r"\b\d{10}[\-/]\d\b", 0.90, "AU", "Privacy-Act-AU/My-Health-Records-Act"),
    ("ABN_AU", r"\b\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", 0.85, "AU", "Privacy-Act-AU"),
    ("PASSPORT_AU", r"\b[A-Z]\d{8}\b", 0.80, "AU", "Privacy-Act-AU"),
    ("MRN", r"\bMRN[:\s#]*\d{5,10}\b", 0.70, "US", "HIPAA"),
    ("NPI", r"\b\d{10}\b", 0.65, "US", "HIPAA"),
    ("DEA_NUMBER", r"\b[A-Z]{2}\d{7}\b", 0.80, "US", "HIPAA"),
    ("HICN", r"\b\d{9}[A-Z]\b", 0.75, "US", "HIPAA"),
    ("HEALTH_PLAN_BENEFICIARY", r"\bHP[A-Z0-9]{8,12}\b", 0.70, "US", "HIPAA"),
    ("ICD10_CODE", r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b", 0.60, "US", "HIPAA"),
    ("STUDENT_ID", r"\b(?:STU|SID|S)(?=[A-Z0-9\-]{4,12}\b)(?=[A-Z0-9\-]*\d)[A-Z0-9\-]{4,12}\b", 0.65, "US", "FERPA"),
    ("BIOMETRIC_IDENTIFIER", r"\b(?:fingerprint|retinal|iris|biometric)\s+(?:id|identifier|scan|record)\b", 0.60, "GLOBAL", "CCPA/GDPR"),
    ("FINANCIAL_ACCOUNT_PAIR", r"\b\d{9}\b.{0,20}\b\d{8,17}\b", 0.70, "GLOBAL", "CCPA/GDPR"),
    ("SURVEY_RESPONSE", r"\b(?:survey|questionnaire|response|answer)\b", 0.55, "US", "PPRA"),
]

# categories of entity types; every other type is PII
CATEGORIES = {
    "CREDIT_CARD": ["PFI", "PCI"], "IBAN": ["PFI", "NPI"], "DATE_OF_BIRTH_DMY": ["PII", "SPII"], "DATE_OF_BIRTH_MDY": ["PII", "SPII"],
    "DATE_OF_BIRTH_ISO": ["PII", "SPII"], "PASSPORT_ICAO": ["PII", "SPII"], "SSN": ["PII", "SPII"], "SSN_NODASH": ["PII", "SPII"],
    "DRIVER_LICENSE_US": ["PII", "SPII"], "EIN": ["PII", "FTI"], "BANK_ROUTING_US": ["PFI", "NPI"], "MEDICARE_BENEFICIARY_ID": ["PHI"],
    "AADHAAR": ["PII", "SPII"], "PAN": ["PII", "FTI"], "PASSPORT_IN": ["PII", "SPII"], "VOTER_ID_IN": ["PII", "SPII"],
    "DRIVER_LICENSE_IN": ["PII", "SPII"], "GST_NUMBER": ["PII", "FTI"], "NATIONAL_INSURANCE_UK": ["PII", "SPII"], "NHS_NUMBER": ["PHI"],
    "PASSPORT_UK": ["PII", "SPII"], "SORT_CODE_UK": ["PFI", "NPI"], "NATIONAL_ID_DE": ["PII", "SPII"], "INSEE_FR": ["PII", "SPII"],
    "DNI_NIE_ES": ["PII", "SPII"], "CODICE_FISCALE_IT": ["PII", "SPII", "FTI"], "SIN_CA": ["PII", "SPII"], "PASSPORT_CA": ["PII", "SPII"],
    "HEALTH_CARD_CA": ["PHI"], "TAX_FILE_NUMBER_AU": ["PII", "FTI"], "MEDICARE_AU": ["PHI"], "PASSPORT_AU": ["PII", "SPII"], "MRN": ["PHI"],
    "NPI": ["PHI"], "DEA_NUMBER": ["PHI"], "HICN": ["PHI"], "HEALTH_PLAN_BENEFICIARY": ["PHI"], "ICD10_CODE": ["PHI"], "STUDENT_ID": ["PII", "SPII"],
    "BIOMETRIC_IDENTIFIER": ["PII", "SPII"], "FINANCIAL_ACCOUNT_PAIR": ["PFI", "NPI"], "NRP": ["PII", "SPII"], "CRYPTO": ["PFI"],
    "MEDICAL_LICENSE": ["PHI"], "US_SSN": ["PII", "SPII"], "US_BANK_NUMBER": ["PFI", "NPI"], "US_DRIVER_LICENSE": ["PII", "SPII"],
    "US_ITIN": ["PII", "FTI"], "US_PASSPORT": ["PII", "SPII"], "UK_NHS": ["PHI"], "PASSWORD": ["CREDENTIALS"], "API_KEY": ["CREDENTIALS"],
    "AWS_ACCESS_KEY": ["CREDENTIALS"], "AZURE_KEY": ["CREDENTIALS"],
}

# words that corroborate a type within a hundred characters
SIGNALS = {
    "SSN": ["ssn", "social security", "sin", "tax id", "tin"], "PERSON": ["name", "employee", "patient", "client", "staff", "person"],
    "EMAIL_ADDRESS": ["email", "e-mail", "contact", "mailto"], "PHONE_NUMBER": ["phone", "tel", "telephone", "call", "fax", "mobile", "cell"],
    "LOCATION": ["address", "addr", "city", "state", "zip", "postal", "street"], "DATE_TIME": ["date", "dob", "born", "birth", "hired", "since"],
    "CREDIT_CARD": ["card", "visa", "mastercard", "amex", "cc", "credit", "payment"],
    "FINANCIAL_ACCOUNT": ["account", "acct", "iban", "routing", "bank", "swift"], "IP_ADDRESS": ["ip address", "host", "server", "network"],
    "DRIVER_LICENSE_US": ["license", "licence", "dl", "driver", "dmv"], "PASSPORT": ["passport", "travel document"],
    "AADHAAR": ["aadhaar", "aadhar", "uid"], "PAN_IN": ["pan", "permanent account"], "NI_UK": ["national insurance", "nino"],
}

# column header words and the type they tell
HEADERS = {
    "ssn": "SSN", "social security": "SSN", "sin": "SSN", "full name": "PERSON", "first name": "PERSON", "last name": "PERSON", "name": "PERSON",
    "email address": "EMAIL_ADDRESS", "e-mail address": "EMAIL_ADDRESS", "e-mail": "EMAIL_ADDRESS", "email": "EMAIL_ADDRESS",
    "telephone": "PHONE_NUMBER", "mobile": "PHONE_NUMBER", "cell": "PHONE_NUMBER", "phone": "PHONE_NUMBER", "postal code": "LOCATION",
    "zip code": "LOCATION", "postal": "LOCATION", "address": "LOCATION", "addr": "LOCATION", "city": "LOCATION", "zip": "LOCATION",
    "date of birth": "DATE_TIME", "dob": "DATE_TIME", "birth": "DATE_TIME", "hired": "DATE_TIME", "date": "DATE_TIME",
    "iban": "FINANCIAL_ACCOUNT", "routing": "FINANCIAL_ACCOUNT", "account number": "FINANCIAL_ACCOUNT", "account": "FINANCIAL_ACCOUNT",
    "acct": "FINANCIAL_ACCOUNT", "policy number": "POLICY_NUMBER", "policy": "POLICY_NUMBER", "passport": "PASSPORT",
    "driver license": "DRIVER_LICENSE_US", "driver licence": "DRIVER_LICENSE_US", "license": "DRIVER_LICENSE_US", "licence": "DRIVER_LICENSE_US",
    "aadhaar": "AADHAAR", "aadhar": "AADHAAR", "pan number": "PAN_IN", "pan": "PAN_IN", "national insurance": "NI_UK", "nino": "NI_UK",
    "ni number": "NI_UK", "ip address": "IP_ADDRESS", "ip": "IP_ADDRESS",
}

# words that look like identifiers and are none
COMMON_WORDS = [
    "statement", "summary", "description", "street", "transactions", "balance", "payment", "opening", "amount", "total", "period", "account", "reference", "number",
    "date", "page", "report", "invoice", "receipt", "credit", "debit", "transfer", "other", "schedule", "subtotal", "category", "status", "address", "telephone",
    "services", "information", "department", "division", "customer", "supplier", "purchase", "discount", "quantity", "interest", "commission", "settlement", "withdrawal",
    "deposit", "processing", "outstanding", "previous", "current", "closing", "narrative", "particulars", "details", "comments", "notes", "clearance", "reversal",
    "adjustment", "reconciliation",
]

# labels of reference numbers
REFERENCE_LABELS = [
    "ref", "ref.", "reference", "ref no", "ref no.", "ref number", "statement nr", "statement nr.", "statement no", "statement no.", "invoice no",
    "invoice no.", "invoice number", "account no", "account no.", "account number", "acct no", "client no", "client no.", "client number", "client",
    "case no", "case no.", "case id", "case number", "file no", "file no.", "file number", "policy no", "policy no.", "policy number", "claim no",
    "claim no.", "claim number", "order no", "order no.", "order number", "receipt no", "receipt no.", "receipt number", "confirmation no",
    "confirmation no.", "confirmation number", "tracking no", "tracking no.", "tracking number", "contract no", "contract no.", "contract number",
    "voucher no", "voucher no.", "voucher number", "transaction id", "transaction no", "trans id", "folio no", "folio no.", "folio", "batch no", "batch no.",
]
BIRTH_WORDS = r"(?i)\b(?:dob|d\.o\.b|date\s+of\s+birth|born|birthday|birth\s+date|birthdate)\b"
DATE_WORDS = r"(?i)\b(?:transaction|period|statement|invoice|posted|effective|due\s+date|payment\s+date|filing|issued|expir|maturity|settlement|created|processed|from|to|ending|beginning|through)\b"
COMPANY_WORDS = r"(?i)\b(?:company|registration|registered|companies\s+house|ltd|plc|limited|inc|incorporated|corp|corporation|llp|reg\s+no|crn|company\s+no)\b"
LICENCE_WORDS = r"(?i)(?:\bdriver|\blicense|\blicence|\bdriving|\bpermit|\bdmv|\bmotor\s+vehicle|\blicen[cs]e\s+no|\blicen[cs]e\s+number|\bDL\s*#|\bDL\s+no|\bDL\b)"
CURRENCY = r"^(?:[$£€¥]\s*[\d,]+(?:\.\d{2})?|[\d,]+(?:\.\d{2})\s+[\d,]+(?:\.\d{2})|[\d]{1,3}(?:,\d{3})+(?:\.\d{2})?|\d+\.\d{2}\s+\d+\.\d{2})$"

# what is masked before a text leaves, in this order
OUTBOUND_MASKS = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"), (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CREDIT_CARD]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"), (r"\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[PHONE]"), (r"\b\d{9}\b", "[SSN]"),
]
LOG_SCRUBS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b\d{3}-?\d{2}-?\d{4}\b", r"\b(?:\d[ -]*?){13,16}\b",
    r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b",
]

# where personal data begins on a page
ONSET_SIGNALS = [r"(?i)\b(name|ssn|date of birth|dob|address|account|policy)\b", r"\d{3}-\d{2}-\d{4}", r"(?i)\b[A-Z]{2}\d{6,}\b"]

DOCUMENT_WORDS = {
    "medical_record": ["patient", "diagnosis", "medical record", "physician", "hospital", "treatment", "mrn", "npi", "hipaa", "health plan", "prescription", "medication", "clinical", "prognosis"],
    "student_file": ["student", "school", "grade", "enrollment", "ferpa", "transcript", "parent/guardian", "academic", "pupil", "semester", "gpa", "course"],
    "financial_statement": ["account", "balance", "transaction", "bank", "routing number", "deposit", "credit card", "statement", "interest", "debit", "wire transfer"],
    "employment_record": ["employee", "employer", "hire date", "salary", "department", "w-2", "payroll", "compensation", "benefits", "termination", "position"],
    "insurance_document": ["policy", "premium", "insured", "beneficiary", "claim", "coverage", "deductible", "underwriter", "policyholder"],
    "legal_document": ["plaintiff", "defendant", "court", "jurisdiction", "hereby", "whereas", "stipulation", "affidavit", "subpoena", "attorney"],
    "correspondence": ["dear", "sincerely", "regards", "re:", "attached", "enclosed", "to whom it may concern"],
    "form_fillable": ["fill in", "check one", "please print", "signature line", "date:", "name:", "applicant"],
}

SECTION_HEADINGS = {
    "patient_information": [r"patient\s+information", r"patient\s+details", r"patient\s+data", r"patient\s+demographics"],
    "provider_information": [r"provider\s+information", r"attending\s+physician", r"physician\s+information", r"provider\s+details", r"referring\s+physician"],
    "emergency_contact": [r"emergency\s+contact", r"next\s+of\s+kin", r"in\s+case\s+of\s+emergency"],
    "student_information": [r"student\s+information", r"pupil\s+record", r"student\s+details", r"student\s+data"],
    "parent_guardian_information": [r"parent\s*[/&]\s*guardian", r"parent\s+information", r"guardian\s+information", r"parent\s+details"],
    "school_information": [r"school\s+information", r"institution\s+information", r"school\s+details"],
    "employee_information": [r"employee\s+information", r"employee\s+details", r"employee\s+data", r"worker\s+information"],
    "employer_information": [r"employer\s+information", r"employer\s+details", r"company\s+information"],
    "account_holder_information": [r"account\s+holder", r"cardholder\s+information", r"customer\s+information"],
    "financial_institution": [r"financial\s+institution", r"bank\s+information", r"issuing\s+bank"],
    "header_footer": [r"page\s+\d+\s+of\s+\d+", r"confidential"],
    "legal_boilerplate": [r"terms\s+and\s+conditions", r"privacy\s+notice", r"disclaimer"],
}
SECTION_COLUMNS = {
    "student name": "student_information", "student id": "student_information", "pupil": "student_information", "patient name": "patient_information",
    "patient id": "patient_information", "mrn": "patient_information", "employee name": "employee_information", "employee id": "employee_information",
    "parent name": "parent_guardian_information", "guardian": "parent_guardian_information", "provider": "provider_information",
    "physician": "provider_information", "school name": "school_information", "institution": "school_information", "employer": "employer_information",
    "company": "employer_information", "account holder": "account_holder_information", "cardholder": "account_holder_information", "bank name": "financial_institution",
}
SECTION_ROLES = {
    "patient_information": "primary_subject", "student_information": "primary_subject", "employee_information": "primary_subject",
    "account_holder_information": "primary_subject", "provider_information": "provider", "school_information": "institutional",
    "employer_information": "institutional", "financial_institution": "institutional", "parent_guardian_information": "secondary_contact",
    "emergency_contact": "secondary_contact", "header_footer": "institutional", "legal_boilerplate": "institutional", "unknown": "unknown",
}

STRUCTURE_CLASSES = {"structured": ["csv", "xlsx", "xls", "parquet", "avro"], "semi-structured": ["html", "htm", "xml", "eml", "msg"], "unstructured": ["pdf", "docx"]}
GOVERNMENT_TYPES = ["US_SSN", "SSN", "US_PASSPORT", "PASSPORT", "US_DRIVER_LICENSE", "DRIVER_LICENSE", "UK_NHS", "UK_NINO", "AU_TFN", "AU_MEDICARE", "IN_AADHAAR", "IN_PAN", "GOVERNMENT_ID"]
HONORIFICS = r"(?i)^(?:miss|mrs|mr|ms|prof|rev|dr|sir|lord|lady|jr|sr|shri|kumari|smt|sri|herr|frau|mme|mlle|m\.|srta|sra)\.?\s+"
NON_LATIN = r"[؀-ۿऀ-ॿ฀-๿぀-ヿ一-鿿가-힯]"
# places that stand second in "City, Country"
PLACES = [
    "india", "united states", "united kingdom", "uk", "us", "usa", "canada", "australia", "germany", "france", "china", "japan", "brazil", "mexico", "italy", "spain",
    "russia", "pakistan", "bangladesh", "nigeria", "egypt", "indonesia", "iran", "turkey", "ukraine", "poland", "netherlands", "belgium", "sweden", "norway", "denmark",
    "finland", "switzerland", "austria", "portugal", "greece", "mumbai", "delhi", "kolkata", "chennai", "bangalore", "hyderabad", "london", "paris", "berlin", "rome",
    "madrid", "beijing", "shanghai", "tokyo", "dubai", "singapore", "maharashtra", "karnataka", "gujarat", "rajasthan", "punjab", "kerala", "tamilnadu", "tamil nadu",
    "andhra pradesh", "telangana", "uttar pradesh", "west bengal", "bihar", "odisha",
]
COUNTRY_WORDS = [
    (r"(?i)\b(?:india|bharat)\b", "IN"), (r"(?i)\b(?:united\s+kingdom|u\.k\.|uk|england|scotland|wales|great\s+britain)\b", "GB"), (r"(?i)\bcanada\b", "CA"),
    (r"(?i)\baustralia\b", "AU"), (r"(?i)\b(?:germany|deutschland)\b", "DE"), (r"(?i)\bfrance\b", "FR"), (r"(?i)\b(?:united\s+states|u\.s\.a\.|u\.s\.|usa)\b", "US"),
]
EXPORT_DEFAULT = ["canonical_name", "canonical_email", "canonical_phone", "pii_types_found", "merge_confidence", "review_status"]
EXPORT_ALLOWED = ["subject_id", "canonical_name", "canonical_email", "canonical_phone", "canonical_address", "pii_types_found", "source_records", "merge_confidence", "notification_required", "review_status"]
LETTER_COLUMNS = ["subject_id", "canonical_name", "street", "city", "state", "zip", "country", "letter_filename", "status", "error"]
ID_FORMS = [r"\d{3}-\d{2}-\d{4}", r"\d{4}-\d{4}-\d{4}-\d{4}", r"\d{3}-\d{3}-\d{4}", r"[A-Z]{2,3}-\d{4,}", r"\d{6,}"]
