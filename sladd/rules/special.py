"""Special-category terms (GDPR Articles 9 and 10)."""

# Fixed values: (label, terms). A category holds when any term occurs as whole
# words, without regard to case. Terms are small patterns.
SPECIAL_CATEGORIES = (
    ("helseopplysninger", (
        "diagnos[ei]", "sykdom", "sjukdom", "sykehus", "sjukehus", "legemiddel", "medisinsk?",
        "helseopplysning(?:ar)?", "allergi", "operasjon", "innleggelse", "poliklinikk",
        "rehabilitering", "prognose", "symptom(?:er)?", "kreft", "diabetes",
        "depresjon", "angst", "psykisk", "psykiatri", "psykose", "psykolog",
        "hiv", "aids", "funksjonshemming", r"neds[ae]tt\s+funksjonsevne",
        "uf[øo]re(?:trygd)?", "pasientjournal", "legejournal", "epj", "helsejour",
        "blodtype", "blodtrykk", "blodpr[øo]ve", "medikament", "medisinering",
        "beh?andling(?:splan)?", "r[øo]ntgen", "ultralyd", "biopsi",
        r"mr(?:[\s-]?bilder?)?", r"ct(?:[\s-]?bilder?)?",
        "sykemelding", "sjukemelding", "sykefrav[æa]r", "resept",
        "rusbehandling", "adhd", "autisme", "demens", "alzheimer", "epilepsi", "astma",
        "diagnosis", "diagnoses", "cancer", "tumou?r", "prescription",
        r"(?:medical|health|patient)[\s-]?record", "psychiatric", "psychiatry", r"mental[\s-]?health",
        "disability", "impairment", r"(?:sick|medical)[\s-]?leave",
        r"blood[\s-]?(?:type|pressure)", "allergy", "x-ray", r"(?:mri|ct)[\s-]?scan",
    )),
    ("genetiske opplysninger", (
        "dna", "genetisk", "genetics?", "arvelighet", "arveleg", "hereditary", "genome?", "kromosom",
        "chromosome", "genmutasjon", "mutation", "gentest", r"genetic[\s-]?test", "brca",
    )),
    ("biometriske opplysninger", (
        "fingeravtrykk", "fingerprint", "ansiktsgjenkjenning", r"(?:facial|face)[\s-]?recognition",
        r"iris(?:skann|[\s-]?scan)?", r"retina(?:[\s-]?scan)?", "biometrisk?", "biometri", "biometrics?",
        "stemmeavtrykk", "voiceprint", r"voice[\s-]?recognition", "dna-profil", "ansiktsskann",
    )),
    ("rase eller etnisk opprinnelse", (
        r"(?:etnisk|nasjonal)\s+(?:opprinnelse|opphav)", r"ethnic[\s-]?origin", "ethnicity", "rasemessig", "racial",
        "hudfarge", r"skin[\s-]?colou?r", "rase(?:diskriminering)?", r"national[\s-]?origin",
        "minoritet(?:sbakgrunn)?", "innvandr[ea]rbakgrunn",
    )),
    ("politisk oppfatning", (
        r"politisk\s+(?:oppfatning|overbevisning|overtyding|syn|tilh[øo]righet)", "partitilh[øo]righet",
        "partitilh[øo]rsle", "partipolitisk", r"stemte?\s+p[åa]", r"r[øo]ysta\s+p[åa]",
        r"political[\s-]?(?:opinion|view|belief|affiliation)", r"party[\s-]?affiliation",
        "arbeiderparti(?:et)?", "h[øo]yre", "fremskrittsparti(?:et)?", "sv", "senterparti(?:et)?", "venstre",
        "krf", "mdg", "r[øo]dt",
    )),
    ("religiøs eller filosofisk overbevisning", (
        "trossamfunn", "trudomssamfunn", "religionsutov", "livssyn", "konfesjon", "muslim", "kristen",
        "christian(?:ity)?", "jødisk", "jewish", "judaism", "hindu", "buddhist", "ateist", "atheist", "agnostic",
        "sikh", "sikhism", "moské", "mosque", "synagoge", "synagogue", "kirkemedlem", "d[åa]p", "baptism",
        "omskj[æa]ring", "circumcision", "ramadan", "sharia", "halal", "kosher", "frikirke",
        r"jehovas\s+vitner", r"jehovah'?s\s+witness(?:es)?", "mormon",
    )),
    ("fagforeningsmedlemskap", (
        "fagforening", "fagforeining", "fagforbund", "fagorganisert", "lo", "ys", "unio", "akademikerne", "nito",
        "fagforbundet", "fellesforbundet", r"industri[\s-]energi", r"el[\s-]og[\s-]it[\s-]forbundet",
        r"handel[\s-]og[\s-]kontor", "fellesorganisasjonen", "transportarbeiderforbundet", "utdanningsforbundet",
        "sykepleierforbundet", r"politiets[\s-]fellesforbund", r"norsk[\s-]tjenestemannslag", "legeforeningen",
        r"den[\s-]norske[\s-]legeforening", "tekna", "juristforbundet", "finansforbundet", "negotia",
        "tillitsvalgt", "tillitsvald", "streik(?:e?rett)?", "tariffavtale", r"kollektiv\s+avtale",
        "fagforeningskontingent", r"(?:trade|labou?r)[\s-]?union", r"union[\s-]?membership", r"shop[\s-]?steward",
        r"collective[\s-]?bargaining",
    )),
    ("seksuelle forhold eller seksuell orientering", (
        r"seksuell\s+orientering", r"sexual[\s-]?orientation", "seksualitet", "homofil", "homosexual", "lesbisk",
        "lesbian", "bifil", "bisexual", "transperson", "transgender", "kj[øo]nnsidentitet",
        r"gender[\s-]?identity", "kj[øo]nnskorrigering", r"gender[\s-]?reassignment", "kj[øo]nnsskifte", "lhbt",
        "lgbt(?:q(?:ia?)?)?", "queer", "ikke-bin[æa]r", r"non[^\n]?binary", "intersex", r"same[^\n]?sex",
    )),
    ("straffbare forhold", (
        "domfelt", "convicted", "conviction", "straffedom", "fengselsstraff", r"prison[\s-]?sentence",
        "imprisonment", "incarceration", "varetektsfengslet", "varetektsfengsla", r"remand(?:\s+custody)?",
        "siktelse", "indictment", "tiltale(?:beslutning)?", "b[øo]telagt", "b[øo]telagd",
        r"kriminell\s+bakgrunn", r"criminal[\s-]?(?:record|background)", "politianmeldelse", "straffeattest",
        "pr[øo]vel[øo]slatelse", "pr[øo]velauslating", "parole", "probation", r"beting(?:et|a)\s+dom",
        r"suspended[\s-]?sentence",
    )),
)

# Short keys used for query and column names, same order.
SPECIAL_KEYS = ("health", "genetic", "biometric", "ethnic", "political", "religion", "union", "sexual", "criminal")
