"""Entity labels, placeholders and thresholds."""

# Entity label -> placeholder written into the output.
ENTITY_TO_PLACEHOLDER = {
    "PERSON": "[NAME]",
    "EMAIL_ADDRESS": "[EMAIL]",
    "PHONE_NUMBER": "[PHONE]",
    "NO_PHONE": "[PHONE]",
    "LOCATION": "[ADDRESS]",
    "NO_ADDRESS": "[ADDRESS]",
    "CREDIT_CARD": "[CREDIT_CARD]",
    "IP_ADDRESS": "[IP_ADDRESS]",
    "DATE_TIME": "[DATO]",
    "IBAN_CODE": "[ACCOUNT_NUMBER]",
    "NO_BANK_ACCOUNT": "[ACCOUNT_NUMBER]",
    "NO_FODSELSNUMMER": "[FØDSELSNUMMER]",
    "NO_ORG_NUMBER": "[ORGNUMMER]",
    "NO_HEALTH_INFO": "[HEALTH_INFO]",
    "MEDICAL_LICENSE": "[HEALTH_INFO]",
    "NRP": "[NAME]",
    "US_SSN": "[FØDSELSNUMMER]",
    "UK_NHS": "[HEALTH_INFO]",
    "US_PASSPORT": "[SENSITIVE_DATA]",
    "US_DRIVER_LICENSE": "[SENSITIVE_DATA]",
    "IN_PAN": "[SENSITIVE_DATA]",
    "SG_NRIC_FIN": "[SENSITIVE_DATA]",
    "AU_ABN": "[ORGNUMMER]",
    "AU_ACN": "[ORGNUMMER]",
    "NO_DATE": "[DATO]",
    "NO_STREET_ADDRESS": "[ADRESSE]",
    "NO_POSTAL_CODE": "[POSTNUMMER]",
    "NO_CITY": "[POSTSTED]",
}

DEFAULT_PLACEHOLDER = "[SENSITIVE_DATA]"

# Acceptance threshold and context boost.
SCORE_THRESHOLD = 0.4
CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.4
CONTEXT_TOKENS = 5

# What a second model may contribute.
SECONDARY_ENTITIES = ("PERSON", "LOCATION")
