"""Fixed values of the catalog domain: word lists, patterns and labels that results depend on, in their own order."""

import unicodedata

# Words left out of tokens.
STOP_WORDS = [
    "de", "da", "do", "dos", "das", "com", "para", "por", "em", "e", "ou", "a", "o", "um", "uma", "ao", "na", "no", "nas", "nos", "se", "que", "ate",
    "mais", "menos", "muito", "pouco", "qual", "quais", "for", "with", "the", "and", "or", "of", "in", "to", "original", "novo", "nova",
    "lancamento", "promocao", "gratis", "frete", "envio", "rapido", "tamanho", "sem", "cor", "tipo", "modelo", "produto",
]

# Words that weigh double.
HIGH_WEIGHT = [
    "vinil", "nitrilo", "latex", "latice", "neoprene", "poliuretano", "plastico", "borracha", "silicone", "polietileno", "polipropileno", "aluminio",
    "aco", "inox", "ferro", "cobre", "madeira", "tnt", "spunbond", "nylon", "poliester", "algodao", "luva", "mascara", "avental", "touca", "oculos",
    "bota", "sapato", "caneta", "esferografica", "lapis", "papel", "caixa", "saco", "sacola", "frasco", "garrafa", "pote", "bandeja", "embalagem",
    "secador", "liquidificador", "batedeira", "mixer", "ventilador", "escova", "esponja", "pano", "tampa", "tubo", "mangueira", "cabo", "fio",
    "tomada", "lampada", "led", "bateria", "pilha", "filtro", "tela", "placa", "parafuso", "prego", "fita", "dispenser", "suporte", "organizador",
    "cesto", "balde", "descartavel", "descartaveis", "reutilizavel", "esteril", "esterilizado", "industrial", "cirurgico", "hospitalar", "ondulada",
    "microondulada", "duplo", "dupla", "profissional", "premium", "reforçado", "reforcado",
]

# Synonyms, applied in this order.
SYNONYMS = [
    (r"\busb\s+tipo\s+c\b", "usbc"),
    (r"\busb\s*c\b", "usbc"),
    (r"\busb\s+tipo\s+a\b", "usba"),
    (r"\busb\s*a\b", "usba"),
    (r"\busb\s+tipo\s+b\b", "usbb"),
    (r"\busb\s*b\b", "usbb"),
    (r"\bmetros?\b", "m"),
    (r"\bcentimetros?\b", "cm"),
    (r"\bmilimetros?\b", "mm"),
    (r"\bpolicadas?\b", "pol"),
    (r"\blitros?\b", "l"),
    (r"\bkilogramas?\b", "kg"),
    (r"\bquilogramas?\b", "kg"),
    (r"\bgramas?\b", "g"),
    (r"\bfls\b", "folhas"),
    (r"\bpcs\b", "pecas"),
    (r"\bund\b", "unid"),
    (r"\bpct\b", "pacote"),
    (r"\bcx\b", "caixa"),
    (r"\bwifi\b", "wireless"),
    (r"\bsem\s*fio\b", "wireless"),
    (r"\bbt\b", "bluetooth"),
]

# Clothing sizes.
SIZES = [
    "pp", "p", "m", "g", "gg", "xg", "xxg", "xs", "s", "l", "xl", "xxl",
]

# What names a kit, and a kit with a quantity.
KIT = (
    r"\bkit\b|\bcombo\b|\bpack\b|\bpacote\b|\bconjunto\b|\bcaixa\s+com\s+\d+|\bcom\s+\d+\s+(?:unid|pares|pecas|pcs)"
    r"|\b\d+\s+(?:unidades|unid|pares|pecas|pcs)\b|\bpar\s+de\b|\b\d+x\d+"
)
COUNTED_KIT = r"\b(?:kit|pack|combo|conjunto|pacote)\s+\d+\b|\b\d+\s+(?:unidades|unid|pares|pecas|pcs)\b|\bcaixa\s+(?:com\s+)?\d+\b"

# Voltages in order of precedence, families of units, amounts.
VOLTAGES = [("bivolt", r"\bbivolt\b"), ("110", r"\b(?:110|127)\s*v\b"), ("220", r"\b220\s*v\b")]
UNIT_FAMILIES = [r"\b(?:ml|l|litro|litros)\b", r"\b(?:g|kg|grama|gramas|quilo)\b", r"\b(?:m|cm|mm)\b"]
AMOUNT = r"\b(\d+(?:[,.]\d+)?)\s*(ml|l|litros?|litro|kg|g|gramas?|grama)\b"

# Wholesale packaging, internal codes before a name, suffixes of quantities.
PACKAGING = (
    r"(?i)\bcx\s*\d*\b|\bfardo\s*\d*\b|\bfd\s*\d*\b|\bpct\s*\d*\b|\bpack\s*\d*\b|\bfco\s*\d*\b|\bc/\s*\d+\b|\bcom\s+\d+\s*unid\w*"
    r"|\b\d+\s*x\s*\d+\b|\blote\s*\d*\b|\b\d+\s*(?:un|unid)\b|\b\d+\s+(?:unidades|pares|pecas|pcs)\b"
)
INTERNAL_CODE = r"(?i)^\s*(?:\d{4,}\s*[-–\s]+|[A-Za-z]{1,4}\s*-\s*\d{2,}\s+|(?:ref|cod|sku|cab|item)\s*[.:]?\s*\S+\s+)"
QUANTITY_SUFFIXES = [
    "un", "unid", "unidades", "pcs", "pecas", "pares",
]

# Units per package in a raw name; above MOST_UNITS it is a dimension.
UNITS_PER_PACKAGE = (
    r"(?i)\bcx\s*c?/?\s*(\d+)\b|\bfardo\s*(\d+)\b|\bfd\s*(\d+)\b|\bpct\s*(\d+)\b|\bpack\s*(\d+)\b|\bfco\s*(\d+)\b|\bc/\s*(\d+)\b|\b(\d{2,3})\s*x\s*\d+\b"
)
MOST_UNITS = 144

# Names of columns by field, in order of preference of fields and of names.
COLUMN_NAMES = {
    "product_name": [
        "nome do produto", "nome produto", "descricao do produto", "nome do item", "descricao do item", "denominacao do produto",
        "especificacao do produto", "produto", "descricao", "denominacao", "especificacao", "mercadoria", "artigo", "material", "componente", "item",
        "nome", "titulo", "product", "description", "name", "item name", "product name", "product description", "article",
    ],
    "cost": [
        "preco de custo", "preco custo", "custo unitario", "valor unitario", "preco unitario", "vl custo", "vlr custo", "vl unit", "vlr unit",
        "valor de custo", "preco de compra", "custo de aquisicao", "preco de venda", "preco venda", "vl venda", "vlr venda", "valor venda",
        "preco tabela", "tabela", "tab", "preco atacado", "atacado", "custo", "preco", "valor", "vl", "vlr", "r$", "reais", "cost", "price",
        "unit price", "unit cost", "buy price", "purchase price", "buying price",
    ],
    "sku": [
        "codigo do produto", "cod produto", "codigo produto", "codigo do item", "numero do produto", "part number", "cod item", "ref produto", "sku",
        "codigo", "cod", "ref", "referencia", "num", "numero", "id", "code", "product code", "item code", "partnumber", "pn",
    ],
    "category": [
        "grupo de produto", "tipo de produto", "linha de produto", "familia de produto", "categoria", "grupo", "tipo", "familia", "departamento",
        "linha", "segmento", "secao", "classificacao", "subgrupo", "category", "group", "type", "family", "department", "section",
    ],
    "supplier": [
        "nome do fornecedor", "nome fornecedor", "fornecedor", "fabricante", "marca", "origem", "produtor", "vendedor", "supplier", "brand",
        "manufacturer", "origin", "vendor",
    ],
}
IGNORED_COLUMNS = ["quantidade", "qty", "qtd", "estoque", "stock", "margem", "margin", "lucro", "profit", "total", "subtotal", "soma", "sum", "obs", "observacao", "nota", "note", "imagem", "foto", "image", "photo", "ncm", "ncm fiscal", "linha", "col"]

# Rows that are totals, names that are headings, sheets that are no catalogs, cells that are empty.
SUBTOTALS = ["total", "subtotal", "soma", "sum", "grand total", "total geral", "total parcial", "totalização", "totalizacao", "total de itens"]
RESERVED_NAMES = ["total", "subtotal", "soma", "item", "produto", "nome", "descricao", "descrição", "n/a", "none", "null", "-", "#"]
OTHER_SHEETS = ["config", "configuracao", "configuração", "setup", "ref", "reference", "lookup", "auxiliar", "aux", "legenda", "legend", "instrucoes", "instruções"]
EMPTY_CELLS = ["nan", "none", "null", "-", "n/a", "#n/d", "#ref!"]

# Columns that hold an exact name to search for.
QUERY_COLUMNS = ["query ml", "query_ml", "ml query", "busca ml"]
MODEL_COLUMNS = ["codigo modelo", "codigo do modelo", "model code", "modelo", "cod modelo"]
BRAND_COLUMNS = ["marca", "brand", "fabricante"]

# Labels of listings and classes.
LOGISTIC_LABELS = {"fulfillment": "Full", "drop_off": "Flex", "self_service": "Proprio", "xd_drop_off": "XD"}
STATUS_LABELS = {"PENDING": "Na fila", "PARSING": "Lendo arquivo", "RESEARCHING": "Pesquisando ML", "ANALYZING": "Analisando", "SCORING": "Calculando", "READY": "Pronto", "ERROR": "Erro"}
CLASSES = ["EXCELENTE", "BOA", "ARRISCADA", "EVITAR"]
OLD_CLASSES = {"ALTA": "EXCELENTE", "MEDIA": "BOA", "BAIXA": "ARRISCADA"}


def unaccented() -> tuple[str, str]:
    """Characters of the Latin blocks whose compatibility form is one character and accents, and those characters."""
    pairs = []
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, BARE = unaccented()
