"""Fixed values of court records: issuing courts, case numbers, dates, parties, places, types; corrections of scans; section headings."""

from __future__ import annotations

# Courts by pattern, in order; \1 and \2 in a name stand for what the pattern's groups found.
COURTS = [
    (r"Corte\s+Suprema\s+de\s+Justicia\s*[\r\n]+\s*SALA\s+DE\s+CASACI[ÓO]N\s+PENAL", "Corte Suprema · Sala Penal"),
    (r"Corte\s+Suprema\s+de\s+Justicia\s*[\r\n]+\s*SALA\s+DE\s+CASACI[ÓO]N\s+CIVIL", "Corte Suprema · Sala Civil"),
    (r"Corte\s+Suprema\s+de\s+Justicia\s*[\r\n]+\s*SALA\s+DE\s+CASACI[ÓO]N\s+LABORAL", "Corte Suprema · Sala Laboral"),
    (r"SALA\s+DE\s+CASACI[ÓO]N\s+PENAL", "Corte Suprema · Sala Penal"),
    (r"Corte\s+Suprema\s+de\s+Justicia", "Corte Suprema de Justicia"),
    (r"Corte\s+Constitucional", "Corte Constitucional"),
    (r"SALA\s+DE\s+LO\s+CONTENCIOSO\s+ADMINISTRATIVO\s+SECCI[OÓ]N\s+TERCERA", "Consejo de Estado · Sección Tercera"),
    (r"SALA\s+DE\s+LO\s+CONTENCIOSO\s+ADMINISTRATIVO\s+SECCI[OÓ]N\s+SEGUNDA", "Consejo de Estado · Sección Segunda"),
    (r"SALA\s+DE\s+LO\s+CONTENCIOSO\s+ADMINISTRATIVO\s+SECCI[OÓ]N\s+PRIMERA", "Consejo de Estado · Sección Primera"),
    (r"SALA\s+DE\s+LO\s+CONTENCIOSO\s+ADMINISTRATIVO\s+SECCI[OÓ]N\s+CUARTA", "Consejo de Estado · Sección Cuarta"),
    (r"SALA\s+DE\s+LO\s+CONTENCIOSO\s+ADMINISTRATIVO\s+SECCI[OÓ]N\s+QUINTA", "Consejo de Estado · Sección Quinta"),
    (r"SALA\s+DE\s+LO\s+CONTENCIOSO\s+ADMINISTRATIVO", "Consejo de Estado · Sala Contencioso"),
    (r"Consejo\s+de\s+Estado", "Consejo de Estado"),
    (r"TRIBUNAL\s+ADMINISTRATIVO\s+DE\s+(?:CUNDINAMARCA|BOGOT[AÁ])", "Tribunal Administrativo de Cundinamarca"),
    (r"TRIBUNAL\s+ADMINISTRATIVO\s+DE\s+ANTIOQUIA", "Tribunal Administrativo de Antioquia"),
    (r"TRIBUNAL\s+ADMINISTRATIVO\s+DE\s+(\w+)", r"Tribunal Administrativo · \1"),
    (r"RAMA\s+JUDICIAL\s+DEL\s+PODER\s+P[UÚ]BLICO", "Rama Judicial"),
    (r"RAMA\s+JUDICIAL", "Rama Judicial"),
    (r"Jurisdicci[oó]n\s+Especial\s+para\s+la\s+Paz|JEP", "JEP"),
    (r"Secci[oó]n\s+de\s+Reconocimiento\s+de\s+Verdad", "JEP · Sección Reconocimiento"),
    (r"Secci[oó]n\s+de\s+Ausencia\s+de\s+Reconocimiento", "JEP · Sección Ausencia"),
    (r"Tribunal\s+para\s+la\s+Paz", "JEP · Tribunal para la Paz"),
    (r"Sala\s+de\s+Amnist[ií]a\s+e\s+Ind[uú]lto", "JEP · Sala Amnistía"),
    (r"Fiscal[ií]a\s+General\s+de\s+la\s+Naci[oó]n", "Fiscalía General de la Nación"),
    (r"Unidad\s+Nacional\s+de\s+Fiscal[ií]as", "Fiscalía · UNASE"),
    (r"Tribunal\s+Superior\s+(?:del?\s+)?(?:Distrito\s+Judicial\s+de\s+)?(\w+)", r"Tribunal Superior · \1"),
    (r"Juzgado\s+(\d+[°º]?)\s+(?:Penal\s+)?(?:del?\s+Circuito|Municipal)(?:\s+de\s+(\w+))?", r"Juzgado \1 · \2"),
    (r"Procuradur[ií]a\s+General\s+de\s+la\s+Naci[oó]n", "Procuraduría General"),
]
# Case numbers, in order (case matters).
CASE_NUMBERS = [
    r"[Rr]adicaci[oó]n\s*(?:n[uú]m\.?\s*)?:?\s*([AS]P\d{1,6}-\d{4}(?:\(\d+\))?)",
    r"\b([AS]P\d{1,6}-\d{4}(?:\(\d+\))?)\b",
    r"[Rr]adicaci[oó]n\s*(?:n[uú]m\.?\s*)?:?\s*(\d{4,6})\b(?!-)",
    r"[Rr]adicado\s*[Nn][oº]?\.?\s*:?\s*(\d{4,6})\b(?!-)",
    r"\b(AC\d{4}-\d{4}(?:\(\d{4}-\d{5}-\d{2}\))?)\b",
    r"[Rr]adicaci[oó]n\s*(?:[Nn]o?\.?\s*)?:?\s*(\d{5}-\d{2}-\d{2}-\d{3}-\d{4}-\d{5}-\d{2}(?:\(\d+\))?)",
    r"(\d{5}-\d{2}-\d{2}-\d{3}-\d{4}-\d{5}-\d{2}(?:\(\d+\))?)",
    r"[Rr]adicado\s*[Nn]o?\.?\s*:?\s*(\d{22,23})",
    r"[Rr]adicado\s*[Nn]o?\.?\s*:?\s*(\d{16}[A-Z]{2})",
    r"Auto\s+[Nn]o?\.\s*(\d{3,4})\s+de\s+(\d{4})",
    r"[Ee]xpediente\s*[Nn]o?\.?\s*:?\s*(\d{4}-\d{5}-\d{2})",
    r"[Pp]roceso\s+(?:[Nn]o?\.?\s*)?(\d{4}-\d{4,6})",
    r"[Mm]acrocaso\s+(?:N[oº]\.?\s*)?(\d{3})",
    r"(?:[Rr]adicado|[Ee]xpediente|[Pp]roceso)\s*:?\s*(\d{10,})",
]
# Case numbers in file names, in order.
FILE_NUMBERS = [r"([AS]P\d{1,6}-\d{4}(?:\(\d+\))?)", r"\((\d{4,6})\)", r"(\d{5}-\d{2}-\d{2}-\d{3}-\d{4}-\d{5}-\d{2}(?:\(\d+\))?)", r"(\d{10,23})"]
# Kinds of documents, in order.
DOC_TYPES = [("sentencia", r"\bsentencia\b"), ("auto", r"\bauto\b(?!\s+de\s+fondo)"), ("providencia", r"\bprovidencia\b"), ("audiencia", r"\baudiencia\b"), ("acta", r"\bacta\s+de\s+audiencia\b"), ("resolucion", r"\bresoluci[oó]n\b"), ("fallo", r"\bfallo\b")]
# Departments and towns, in order.
PLACES = "Antioquia|Atlántico|Bogotá|Bolívar|Boyacá|Caldas|Caquetá|Casanare|Cauca|Cesar|Chocó|Córdoba|Cundinamarca|Guajira|Huila|Magdalena|Meta|Nariño|Norte de Santander|Putumayo|Quindío|Risaralda|Santander|Sucre|Tolima|Valle del Cauca|Arauca|Vichada|Vaupés|Medellín|Cali|Barranquilla|Cartagena|Bucaramanga|Cúcuta|Montería|Villavicencio|Sincelejo|Pasto|Soacha|La Guajira".split("|")
# Months and their short forms; words for years.
MONTHS = {m: i + 1 for i, m in enumerate("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())} | {m: i + 1 for i, m in enumerate("ene feb mar abr may jun jul ago sep oct nov dic".split())}
UNITS = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte veintiuno veintidos veintitres veinticuatro".split()
YEARS = {"dos mil": 2000, "mil novecientos noventa": 1990} | {f"dos mil {u}": 2001 + i for i, u in enumerate(UNITS)} | {f"mil novecientos noventa y {u}": 1991 + i for i, u in enumerate(UNITS[:9])}
# A month; a year in words; dates in words, in order: pattern, and how its year is told: in digits, in words, or in digits from 2000 to 2025.
MONTH = "(" + "|".join(MONTHS) + ")"
YEAR_WORDS = r"(?:mil\s+novecientos\s+\w+(?:\s+y\s+\w+)?|dos\s+mil(?:\s+\w+)?)"
DATES = [
    (rf"\(\s*(\d{{1,2}})\s*\)\s+de\s+{MONTH}\s+de\s+dos\s+mil(?:\s+\w+)?\s*\(\s*(\d{{4}})\s*\)", "digits"),
    (rf"\(\s*(\d{{1,2}})\s*\)\s+de\s+{MONTH}\s+de\s+mil\s+novecientos\s+\w+(?:\s+y\s+\w+)?\s*\(\s*(\d{{4}})\s*\)", "digits"),
    (rf"(\d{{1,2}})\s+de\s+{MONTH}\s+de\s+(\d{{4}})", "recent"),
    (rf"(\d{{1,2}})\s+de\s+{MONTH}\s+de\s+(dos\s+mil(?:\s+\w+)?)", "words"),
    (rf"(\d{{1,2}})\s+de\s+{MONTH}\s+de\s+(mil\s+novecientos\s+\w+(?:\s+y\s+\w+)?)", "words"),
    (rf"(\d{{1,2}})\s+de\s+{MONTH}\s+de\s+{YEAR_WORDS}\s*\(\s*(\d{{4}})\s*\)", "digits"),
]
# Parties; ranks and titles may stand before a name.
RANKS = r"(?:(?:Sargento\s+(?:Primero|Segundo|Mayor)|Cabo\s+(?:Primero|Segundo)|Suboficial|Teniente\s+(?:Coronel)?|Mayor|Coronel\s*(?:\(R\))?|General|Brigadier|Capitán|Subteniente|Soldado|Dr\.?|Dra\.?|Señor|Señora)\s+)*"
NAME = r"([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+){1,4})"
PARTIES = {
    "procesado": [r"(?:[Pp]rocesado|[Aa]cusado|[Ii]mputado|[Cc]ompareciente)[:\s]+" + RANKS + NAME, r"[Cc]ontra\s+" + RANKS + NAME],
    "fiscal": [r"[Ff]iscal\s+(?:\d+[°º]?\s+)?(?:delegado\s+)?([A-Z][a-záéíóúñ]+(?:\s+[A-Z][a-záéíóúñ]+){1,2})"],
    "defensor": [r"[Dd]efensor(?:a)?\s+(?:de\s+oficio\s+)?([A-Z][a-záéíóúñ]+(?:\s+[A-Z][a-záéíóúñ]+){1,2})"],
    "victima": [r"(?:v[ií]ctima|familiar|MAFAPO)[:\s]+([A-Z][a-záéíóúñ]+(?:\s+[A-Z][a-záéíóúñ]+){1,3})"],
}
# Weights of what was found.
CONFIDENCE = {"tribunal": 0.25, "case_number": 0.30, "date_issued": 0.20, "parties": 0.10, "region": 0.05, "doc_type": 0.10}

# Corrections of scanned texts, in order; case does not matter. Texts that look-behind and look-ahead hold stay.
SCAN_CORRECTIONS = [
    (r"\bI\b(?=[a-záéíóúñ])", "l"),
    (r"(?<=[a-záéíóúñ])0(?=[a-záéíóúñ])", "o"),
    (r"(?<=[a-záéíóúñ])1(?=[a-záéíóúñ])", "l"),
    (r"\brn\b", "m"),
    (r"(?<=[a-z])rn(?=[a-z])", "m"),
    (r"vv(?=[aeiouáéíóú])", "w"),
    (r"\bSenten[c|ç]ia\b", "Sentencia"),
    (r"\bJurisdicci[o0]n\b", "Jurisdicción"),
    (r"\bEjecu[c|ç]i[o0]n\b", "Ejecución"),
    (r"\bFiscal[i|í]a\b", "Fiscalía"),
    (r"\bProcurad[u|ú]r[i|í]a\b", "Procuraduría"),
    (r"\bContralorí[a|@]\b", "Contraloría"),
    (r"\bdefen[s|5]or\b", "defensor"),
    (r"\bprinci[p|r]io\b", "principio"),
    (r"\bha[b|6]eas\s+corpus\b", "habeas corpus"),
    (r"\bJEP\b", "JEP"),
    (r"\bMAFAPO\b", "MAFAPO"),
    (r"(\w+)-\n(\w+)", "$1$2"),
    (r"\bArt[i|í][c|ç]ulo\b", "Artículo"),
    (r"\bNum[e|3]ral\b", "Numeral"),
    (r"[|]{2,}", "ll"),
    (r"\b[li]{2}(?=[aeiouáéíóú])", "ll"),
]
# Rewrites of the second cleaner, in order.
PLAIN_CLEANER = [(r"\r\n|\r", "\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+", " "), (r"(?m)^\s*\d+\s*$", ""), (r"Jurisdicción Especial para la Paz\s*", ""), (r"Sala de Reconocimiento.*?\n", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]

# Section headings by kind of corpus: label, patterns, whether it is a target. Case does not matter, ^ and $ are line edges.
_A, _B, _LINE = r"(?:^|\n)(?:[IVXLC]+\.?\s+)?", r"(?:^|\n)(?:[IVXLC]+\.\s+)?", r"(?:\s*:|\s*\n)"
SECTIONS = {
    "A": [
        ("ENCABEZADO", [r"^(?:TRIBUNAL|JUZGADO|CORTE|FISCALÍA|REPÚBLICA\s+DE\s+COLOMBIA)", r"^(?:EXPEDIENTE|RADICADO|PROCESO)\s+N"], False),
        ("HECHOS", [_A + r"(?:LOS\s+)?HECHOS?\s+JURI[DÍ]DICAMENTE\s+RELEVANTES?" + _LINE, _A + r"(?:LOS\s+)?HECHOS?(?:\s+PROBADOS?)?" + _LINE, _A + r"RELACI[ÓO]N\s+DE\s+HECHOS", _A + r"CIRCUNSTANCIAS\s+F[ÁA]CTICAS", r"(?:^|\n)PLANTEAMIENTO\s+DEL\s+CASO", _A + r"SITUACI[ÓO]N\s+F[ÁA]CTICA"], True),
        ("CARGOS", [_A + x + _LINE for x in (r"CARGOS?", r"CARGO\s+[ÚU]NICO", r"PRIMER\s+CARGO", r"SEGUNDO\s+CARGO", r"DEMANDA\s+DE\s+CASACI[ÓO]N", r"FUNDAMENTOS?\s+DE\s+LA\s+CASACI[ÓO]N")], True),
        ("CONSIDERACIONES", [_A + r"CONSIDERACIONES?\s+DE\s+LA\s+CORTE" + _LINE, _A + r"CONSIDERACIONES?(?:\s+DEL?\s+(?:TRIBUNAL|JUZGADO|DESPACHO|SALA))?" + _LINE, _A + r"FUNDAMENTOS?\s+(?:JURI[DÍ]DICOS?|DE\s+DERECHO)", _A + r"MARCO\s+JUR[IÍ]DICO", _A + r"AN[ÁA]LISIS\s+(?:JURI[DÍ]DICO|DEL?\s+CASO)", _A + r"PROBLEMA\s+JUR[IÍ]DICO" + _LINE], True),
        ("ANTECEDENTES", [_A + x + _LINE for x in (r"ANTECEDENTES?", r"RESUMEN\s+(?:DEL?\s+CASO|PROCESAL)", r"ACTUACI[ÓO]N\s+PROCESAL")], False),
        ("PRUEBAS", [_A + r"(?:VALORACI[ÓO]N\s+)?PRUEBAS?" + _LINE, _A + r"MATERIAL\s+PROBATORIO", _A + r"M[ÉE]RITOS\s+(?:Y\s+)?PRUEBAS?"], False),
        ("DECISIÓN", [*(_A + x + _LINE for x in (r"DECISI[ÓO]N", "RESUELVE", "FALLA")), r"(?:^|\n)EN\s+M[ÉE]RITO\s+DE\s+LO\s+EXPUESTO", r"(?:^|\n)POR\s+LO\s+EXPUESTO[,\s]+(?:LA\s+)?(?:CORTE|SALA|JUZGADO|TRIBUNAL|DESPACHO)", _A + r"PARTE\s+RESOLUTIVA" + _LINE], True),
    ],
    "B": [
        ("ENCABEZADO", [r"^REPÚBLICA\s+DE\s+COLOMBIA\s*$", r"^AUTO\s+(?:CDG|N[Oº]\.?|No\.?)\s*[-–]?\s*(?:No\.?\s*)?\d"], False),
        ("ASUNTO", [r"(?:^|\n)I\.\s+ASUNTO\s*$", r"(?:^|\n)I\.\s+OBJETO\s+(?:DEL?\s+AUTO|DE\s+LA\s+PROVIDENCIA)\s*$", r"(?:^|\n)ASUNTO\s*$"], False),
        ("ANTECEDENTES", [_B + x + r"\s*$" for x in (r"ANTECEDENTES?", r"ANTECEDENTES?\s+(?:PROCESALES?|DEL?\s+CASO)", r"HECHOS?\s+RELEVANTES?")], False),
        ("HECHOS_Y_CONDUCTAS", [_B + x + r"\s*$" for x in (r"DETERMINACI[ÓO]N\s+DE\s+(?:LOS\s+)?HECHOS\s+Y\s+CONDUCTAS", r"HECHOS\s+Y\s+CONDUCTAS", r"DESCRIPCI[ÓO]N\s+DE\s+(?:LOS\s+)?HECHOS", r"UNIVERSO\s+DE\s+(?:LAS\s+)?V[IÍ]CTIMAS")], True),
        ("PATRONES_MACROCRIMINALES", [_B + x + r"\s*$" for x in (r"PATRONES?\s+(?:MACRO)?CRIMINALES?", r"MODALIDADES?\s+(?:DE\s+)?(?:LA\s+)?CONDUCTA", r"MODUS\s+OPERANDI")], True),
        ("CALIFICACION_JURIDICA", [_B + x + r"\s*$" for x in (r"CALIFICACI[ÓO]N\s+JUR[IÍ]DICA", r"TIPIFICACI[ÓO]N\s+(?:DE\s+(?:LAS?\s+)?CONDUCTAS?)?", r"CR[IÍ]MENES?\s+INTERNACIONALES?")], True),
        ("RECONOCIMIENTO", [_B + x + r"\s*$" for x in (r"RECONOCIMIENTO\s+DE\s+(?:VERDAD|RESPONSABILIDAD)", r"DECLARACI[ÓO]N\s+DE\s+RECONOCIMIENTO", r"APORTE\s+A\s+LA\s+VERDAD")], True),
        ("CONSIDERACIONES", [_B + x + r"\s*$" for x in (r"CONSIDERACIONES?", r"CONSIDERACIONES?\s+(?:DE\s+LA\s+SALA|JUR[IÍ]DICAS?)", r"AN[ÁA]LISIS\s+JUR[IÍ]DICO", r"MARCO\s+(?:JUR[IÍ]DICO|NORMATIVO)")], True),
        ("RESUELVE", [_B + r"RESUELVE\s*$", _B + r"PARTE\s+RESOLUTIVA\s*$", _B + r"EN\s+VIRTUD\s+DE\s+LO\s+EXPUESTO\s*[,:]?\s*$"], True),
    ],
    "C": [
        ("ENCABEZADO", [r"^(?:ACTA|TRANSCRIPCI[ÓO]N)\s+(?:DE\s+)?AUDIENCIA", r"^JEP[,\s]"], False),
        ("APERTURA", [r"(?:^|\n)(?:APERTURA|INSTALACI[ÓO]N)\s+(?:DE\s+LA\s+)?AUDIENCIA" + _LINE, r"(?:^|\n)PRESIDENTE[:\s]+(?:Se\s+instala|Declaramos)"], False),
        ("TESTIMONIO_COMPARECIENTE", [r"(?:^|\n)(?:DECLARACI[ÓO]N|INTERVENCI[ÓO]N)\s+(?:DEL?\s+)?COMPARECIENTE" + _LINE, r"(?:^|\n)COMPARECIENTE[:\s]+", r"(?:^|\n)RECONOCIMIENTO\s+P[ÚU]BLICO" + _LINE], True),
        ("TESTIMONIO_VICTIMA", [r"(?:^|\n)(?:DECLARACI[ÓO]N|INTERVENCI[ÓO]N)\s+(?:DE\s+(?:LA\s+)?)?V[ÍI]CTIMA" + _LINE, r"(?:^|\n)V[ÍI]CTIMA[:\s]+", r"(?:^|\n)FAMILIAR(?:\s+DE\s+V[ÍI]CTIMA)?[:\s]+", r"(?:^|\n)REPRESENTANTE\s+(?:DE\s+)?(?:LAS?\s+)?V[ÍI]CTIMAS?[:\s]+"], True),
        ("DELIBERACION", [r"(?:^|\n)(?:DELIBERACI[ÓO]N|DEBATE)" + _LINE, r"(?:^|\n)PREGUNTAS?\s+(?:DEL?\s+)?(?:MAGISTRADO|JUEZ|SALA)" + _LINE], True),
        ("CIERRE", [r"(?:^|\n)CIERRE\s+(?:DE\s+LA\s+)?AUDIENCIA" + _LINE, r"(?:^|\n)(?:SE\s+)?(?:LEVANTA|SUSPENDE)\s+(?:LA\s+)?AUDIENCIA", r"(?:^|\n)(?:PRESIDENTE|MAGISTRADO)[:\s]+(?:Se\s+)?(?:levanta|declara\s+terminada)"], False),
    ],
}

# The looser headings of a second version, which also end in a colon; those of C are the same.
SECTIONS_LOOSE = {
    "A": [
        ("ENCABEZADO", [r"^(?:TRIBUNAL|JUZGADO|CORTE|FISCALÍA|REPÚBLICA\s+DE\s+COLOMBIA)", r"^(?:EXPEDIENTE|RADICADO|PROCESO)\s+N"], False),
        ("HECHOS", [
            r"(?:^|\n)(?:I+\.?\s+)?(?:LOS\s+)?HECHOS?(?:\s+PROBADOS?)?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:I+\.?\s+)?RELACI[ÓO]N\s+DE\s+HECHOS",
            r"(?:^|\n)(?:I+\.?\s+)?CIRCUNSTANCIAS\s+F[ÁA]CTICAS",
            r"(?:^|\n)PLANTEAMIENTO\s+DEL\s+CASO",
        ], True),
        ("CONSIDERACIONES", [
            r"(?:^|\n)(?:II+\.?\s+)?CONSIDERACIONES?(?:\s+DEL?\s+(?:TRIBUNAL|JUZGADO|DESPACHO))?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:II+\.?\s+)?FUNDAMENTOS?\s+(?:JURI[DÍ]DICOS?|DE\s+DERECHO)",
            r"(?:^|\n)(?:II+\.?\s+)?MARCO\s+JUR[IÍ]DICO",
            r"(?:^|\n)(?:II+\.?\s+)?AN[ÁA]LISIS\s+(?:JURI[DÍ]DICO|DEL?\s+CASO)",
        ], True),
        ("PRUEBAS", [
            r"(?:^|\n)(?:II+\.?\s+)?(?:VALORACI[ÓO]N\s+)?PRUEBAS?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:II+\.?\s+)?MATERIAL\s+PROBATORIO",
            r"(?:^|\n)(?:II+\.?\s+)?M[ÉE]RITOS\s+(?:Y\s+)?PRUEBAS?",
        ], False),
        ("DECISIÓN", [
            r"(?:^|\n)(?:IV+\.?\s+)?DECISI[ÓO]N(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:IV+\.?\s+)?RESUELVE(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:IV+\.?\s+)?FALLA(?:\s*:|\s*\n)",
            r"(?:^|\n)EN\s+M[ÉE]RITO\s+DE\s+LO\s+EXPUESTO",
            r"(?:^|\n)POR\s+LO\s+EXPUESTO[,\s]+(?:ESTE|EL)\s+(?:JUZGADO|TRIBUNAL|DESPACHO)",
        ], True),
    ],
    "B": [
        ("ENCABEZADO", [r"^(?:JURISDICCI[ÓO]N\s+ESPECIAL\s+PARA\s+LA\s+PAZ|JEP)", r"^(?:SALA\s+DE\s+RECONOCIMIENTO|SECCI[ÓO]N\s+DE)", r"^AUTO\s+N[Oº]\.", r"^REPÚBLICA\s+DE\s+COLOMBIA"], False),
        ("ANTECEDENTES", [
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?ANTECEDENTES?(?:\s+(?:PROCESALES?|DEL?\s+CASO))?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?HECHOS?\s+RELEVANTES?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?CONTEXTO(?:\s+(?:GENERAL|F[ÁA]CTICO))?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?OBJETO\s+(?:DEL?\s+AUTO|DE\s+LA\s+PROVIDENCIA)(?:\s*:|\s*\n)",
        ], False),
        ("HECHOS_Y_CONDUCTAS", [
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?DETERMINACI[ÓO]N\s+DE\s+(?:LOS\s+)?HECHOS\s+Y\s+CONDUCTAS(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?HECHOS\s+Y\s+CONDUCTAS(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?DESCRIPCI[ÓO]N\s+DE\s+(?:LOS\s+)?HECHOS(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?LOS\s+HECHOS(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?UNIVERSO\s+DE\s+(?:LAS\s+)?V[IÍ]CTIMAS(?:\s*:|\s*\n)",
        ], True),
        ("PATRONES_MACROCRIMINALES", [
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?PATRONES?\s+(?:MACRO)?CRIMINALES?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?MODALIDADES?\s+(?:DE\s+(?:LA\s+)?CONDUCTA|CRIMINAL)(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?MODUS\s+OPERANDI(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?SISTEMA\s+(?:DE\s+)?CRIMEN(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?PRÁCTICA\s+(?:SISTEM[ÁA]TICA|CRIMINAL)(?:\s*:|\s*\n)",
        ], True),
        ("CALIFICACION_JURIDICA", [
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?CALIFICACI[ÓO]N\s+JUR[IÍ]DICA(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?TIPIFICACI[ÓO]N\s+(?:DE\s+(?:LAS?\s+)?CONDUCTAS?)?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?CR[IÍ]MENES?\s+INTERNACIONALES?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?CL[ÁA]SIFICACI[ÓO]N\s+(?:DE\s+(?:LOS\s+)?HECHOS)?(?:\s*:|\s*\n)",
        ], True),
        ("RECONOCIMIENTO", [
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?RECONOCIMIENTO\s+DE\s+(?:VERDAD|RESPONSABILIDAD)(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?DECLARACI[ÓO]N\s+DE\s+RECONOCIMIENTO(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?APORTE\s+A\s+LA\s+VERDAD(?:\s*:|\s*\n)",
            r"(?:^|\n)RECONOCE\s+(?:SU\s+)?RESPONSABILIDAD",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?COMPROMISOS?\s+(?:DE\s+)?RECONOCIMIENTO(?:\s*:|\s*\n)",
        ], True),
        ("CONSIDERACIONES", [
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?CONSIDERACIONES?(?:\s+(?:DE\s+LA\s+SALA|JUR[IÍ]DICAS?))?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?AN[ÁA]LISIS\s+JUR[IÍ]DICO(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?FUNDAMENTOS?\s+JUR[IÍ]DICOS?(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?MARCO\s+(?:JUR[IÍ]DICO|NORMATIVO)(?:\s*:|\s*\n)",
        ], True),
        ("RESUELVE", [
            r"(?:^|\n)RESUELVE(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?EN\s+VIRTUD\s+DE\s+LO\s+EXPUESTO",
            r"(?:^|\n)(?:DECISI[ÓO]N\s+)?DE\s+LA\s+SALA(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?PARTE\s+RESOLUTIVA(?:\s*:|\s*\n)",
            r"(?:^|\n)(?:[IVXLC]+\.?\s+)?ORDENA(?:\s*:|\s*\n)",
        ], True),
    ],
    "C": SECTIONS["C"],
}
