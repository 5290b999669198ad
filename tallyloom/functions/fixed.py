"""Lists and patterns that decide results and are stated as they are."""

from __future__ import annotations

#: ISO-4217 codes that count as valid.
CURRENCIES = [
    "AED", "AFN", "ALL", "AMD", "ANG", "AOA", "ARS", "AUD", "AWG", "AZN", "BAM", "BBD", "BDT", "BGN", "BHD", "BIF", "BMD", "BND", "BOB", "BRL", "BSD", "BTN", "BWP", "BYN",
    "BZD", "CAD", "CDF", "CHF", "CLP", "CNY", "COP", "CRC", "CUC", "CUP", "CVE", "CZK", "DJF", "DKK", "DOP", "DZD", "EGP", "ERN", "ETB", "EUR", "FJD", "FKP", "GBP", "GEL",
    "GHS", "GIP", "GMD", "GNF", "GTQ", "GYD", "HKD", "HNL", "HRK", "HTG", "HUF", "IDR", "ILS", "INR", "IQD", "IRR", "ISK", "JMD", "JOD", "JPY", "KES", "KGS", "KHR", "KMF",
    "KPW", "KRW", "KWD", "KYD", "KZT", "LAK", "LBP", "LKR", "LRD", "LSL", "LYD", "MAD", "MDL", "MGA", "MKD", "MMK", "MNT", "MOP", "MRU", "MUR", "MVR", "MWK", "MXN", "MYR",
    "MZN", "NAD", "NGN", "NIO", "NOK", "NPR", "NZD", "OMR", "PAB", "PEN", "PGK", "PHP", "PKR", "PLN", "PYG", "QAR", "RON", "RSD", "RUB", "RWF", "SAR", "SBD", "SCR", "SDG",
    "SEK", "SGD", "SHP", "SLL", "SOS", "SRD", "SSP", "STN", "SVC", "SYP", "SZL", "THB", "TJS", "TMT", "TND", "TOP", "TRY", "TTD", "TWD", "TZS", "UAH", "UGX", "USD", "UYU",
    "UZS", "VES", "VND", "VUV", "WST", "XAF", "XCD", "XOF", "XPF", "YER", "ZAR", "ZMW", "ZWL",
]

#: Country codes and names that count as valid.
COUNTRIES = [
    "US", "USA", "UNITED STATES", "GB", "GBR", "UNITED KINGDOM", "CA", "CAN", "CANADA", "FR", "FRA", "FRANCE", "DE", "DEU", "GERMANY",
    "IN", "IND", "INDIA", "AU", "AUS", "AUSTRALIA", "JP", "JPN", "JAPAN", "CN", "CHN", "CHINA", "BR", "BRA", "BRAZIL", "RU", "RUS", "RUSSIA",
    "ZA", "ZAF", "SOUTH AFRICA", "MX", "MEX", "MEXICO", "IT", "ITA", "ITALY", "ES", "ESP", "SPAIN", "NL", "NLD", "NETHERLANDS",
    "CH", "CHE", "SWITZERLAND", "SE", "SWE", "SWEDEN", "NO", "NOR", "NORWAY", "FI", "FIN", "FINLAND", "DK", "DNK", "DENMARK",
    "SG", "SGP", "SINGAPORE", "NZ", "NZL", "NEW ZEALAND", "AE", "ARE", "UNITED ARAB EMIRATES", "SA", "SAU", "SAUDI ARABIA",
    "KR", "KOR", "SOUTH KOREA", "KP", "PRK", "NORTH KOREA", "AR", "ARG", "ARGENTINA", "CO", "COL", "COLOMBIA", "CL", "CHL", "CHILE",
    "PE", "PER", "PERU", "VE", "VEN", "VENEZUELA", "MY", "MYS", "MALAYSIA", "ID", "IDN", "INDONESIA", "TH", "THA", "THAILAND",
    "PH", "PHL", "PHILIPPINES", "VN", "VNM", "VIETNAM", "PK", "PAK", "PAKISTAN", "BD", "BGD", "BANGLADESH", "TR", "TUR", "TURKEY",
    "PL", "POL", "POLAND", "UA", "UKR", "UKRAINE", "BE", "BEL", "BELGIUM", "AT", "AUT", "AUSTRIA", "IE", "IRL", "IRELAND",
    "PT", "PRT", "PORTUGAL", "GR", "GRC", "GREECE",
]

#: Canonical targets in order of precedence: entity, field, type, synonyms.
REGISTRY = [
    ("customers", "name", "FREE_TEXT", ["customer_name", "cust_name", "client_name", "buyer_name", "customer"]),
    ("customers", "email", "EMAIL", ["mail", "email_address", "contact_email"]),
    ("customers", "phone", "PHONE", ["phone_number", "contact_no", "tel", "telephone"]),
    ("customers", "segment", "CATEGORY", ["cust_segment", "group", "division"]),
    ("products", "sku", "FREE_TEXT", ["sku", "product_code", "item_code", "prod_id"]),
    ("products", "name", "FREE_TEXT", ["product_name", "item", "description", "prod_name"]),
    ("products", "category", "CATEGORY", ["prod_category", "category", "dept", "department"]),
    ("products", "sub_category", "CATEGORY", ["sub_category", "subcategory", "group"]),
    ("products", "unit_price", "DECIMAL", ["price", "unit_price", "cost"]),
    ("products", "currency", "CATEGORY", ["curr", "currency_code", "valuta"]),
    ("orders", "order_date", "DATE", ["order_date", "date", "transaction_date"]),
    ("orders", "ship_date", "DATE", ["ship_date", "shipping_date", "delivery_date"]),
    ("orders", "ship_mode", "CATEGORY", ["ship_mode", "shipping_method", "carrier"]),
    ("orders", "shipping_cost", "DECIMAL", ["shipping_cost", "freight", "shipping_fee"]),
    ("orders", "total_amount", "DECIMAL", ["sales", "revenue", "total", "amount", "order_total"]),
    ("orders", "currency", "CATEGORY", ["curr", "currency_code"]),
]

#: Date formats in order of precedence, with what a value of each looks like.
_D, _M, _Y = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])", "[0-9]{4}"
_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_FORMATS = [
    ("yyyy-MM-dd", f"{_Y}-{_M}-{_D}"),
    ("dd/MM/yyyy", f"{_D}/{_M}/{_Y}"),
    ("MM/dd/yyyy", f"{_M}/{_D}/{_Y}"),
    ("yyyy-MM-dd'T'HH:mm:ss", f"{_Y}-{_M}-{_D}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"),
    ("MMM d, yyyy", f"{_MON} ([1-9]|[12][0-9]|3[01]), {_Y}"),
    ("dd-MMM-yyyy", f"{_D}-{_MON}-{_Y}"),
    ("yyyy/MM/dd", f"{_Y}/{_M}/{_D}"),
    ("dd.MM.yyyy", f"{_D}\\.{_M}\\.{_Y}"),
]
DATETIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
#: Formats that the validity rule accepts for dates.
RULE_DATES = [f"{_Y}-{_M}-{_D}", f"{_M}/{_D}/{_Y}", f"{_D}-{_M}-{_Y}"]

EMAIL = "[^@\\s]+@[^@\\s]+\\.[^@\\s]+"
#: Share of each dimension in the overall score.
WEIGHTS = {"COMPLETENESS": "0.20", "VALIDITY": "0.25", "UNIQUENESS": "0.20", "CONSISTENCY": "0.20", "TIMELINESS": "0.10", "ACCURACY": "0.05"}
PENALTIES = {"CRITICAL": "1.0", "HIGH": "0.5", "MEDIUM": "0.2", "LOW": "0.05"}
GRADES = [("0.95", "A"), ("0.85", "B"), ("0.70", "C"), ("0.55", "D")]

#: What a record is rejected for.
MISSING = "Required field '{}' is null or blank"
#: What values of inferred types look like.
TYPE_EMAIL = "[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
TYPE_PHONE = "\\+?[0-9\\-\\s().]{7,20}"
TYPE_AMOUNT = "[$€£¥]\\s*[0-9]+(\\.[0-9]{1,2})?|[0-9]+(\\.[0-9]{1,2})?\\s*[$€£¥]"
