"""Languages the rules cover, and a small Norwegian training text for the language model."""

# Supported codes, sample size, shortest sample, required probability.
SUPPORTED_LANGUAGES = ("en", "nb", "no", "nn")
SAMPLE_CHARS = 3000
MIN_SAMPLE_CHARS = 30
MIN_PROBABILITY = 0.70

# Own sentences; the supplied corpora hold no Norwegian.
NORWEGIAN_TRAINING_TEXT = (
    "Kommunen har mottatt søknaden og behandler den så snart som mulig. Du får svar i løpet av fire uker. "
    "Dersom du ikke hører noe fra oss, kan du ringe sentralbordet mellom klokka ni og tre. "
    "Møtet ble holdt på rådhuset, og de fleste av medlemmene var til stede. Referatet sendes til alle deltakerne. "
    "Hun flyttet til Trondheim for å studere, men kom tilbake etter to år fordi hun savnet fjorden og fjellet. "
    "Regjeringen foreslår å øke støtten til barnehagene, slik at flere foreldre kan komme raskere ut i arbeid. "
    "Det er viktig at opplysningene er riktige, og at ingen andre enn saksbehandleren har tilgang til dem. "
    "Været blir kaldt og klart i helgen, med litt snø langs kysten og sterk vind i høyden. "
    "Vi ønsker å takke alle som har hjulpet oss gjennom et vanskelig år, både naboer, venner og familie."
)
