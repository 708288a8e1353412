"""Types and label vocabularies. The order of the vocabularies has meaning."""

from __future__ import annotations

# Span types, document categories, levels, and how a span type is reported (type, personal, number type).
SPAN_TYPES = "PERSON EMAIL EMAIL_GENERIC PHONE PHONE_CORPORATE MY_NUMBER NATIONAL_ID PASSPORT_LICENCE CREDIT_CARD BANK_ACCOUNT ORDER_TRACKING SERIAL ADDRESS ADDRESS_CORPORATE DATE_OF_BIRTH EMPLOYMENT HANDLE HANDLE_BRAND IP_PERSONAL IP_SERVER MEMBER_ID".split()
BIO = ["O", *(f"{part}-{kind}" for kind in SPAN_TYPES for part in "BI")]
CATEGORIES = "person_name email_or_phone postal_address date_of_birth government_id financial_account health_info biometric_or_genetic ip_address_of_a_person sns_handle employment_info race_or_religion political_or_union sex_life_or_orientation citizenship_or_immigration precise_location credentials private_communications hr_or_criminal_record".split()
LEVELS = ["none", "low", "high"]
RANK = {level: rank for rank, level in enumerate(LEVELS)}
HIGH_CATEGORIES = frozenset("race_or_religion political_or_union health_info sex_life_or_orientation biometric_or_genetic hr_or_criminal_record citizenship_or_immigration government_id financial_account credentials precise_location private_communications".split())
REPORT = {
    "PERSON": ("person_name", True, None), "EMAIL": ("email", True, None), "EMAIL_GENERIC": ("email", False, None), "PHONE": ("phone", True, None),
    "PHONE_CORPORATE": ("phone", False, None), "MY_NUMBER": ("number", True, "my_number"), "NATIONAL_ID": ("number", True, "national_id"),
    "PASSPORT_LICENCE": ("number", True, "driver_licence_or_passport"), "CREDIT_CARD": ("number", True, "credit_card"), "BANK_ACCOUNT": ("number", True, "bank_account"),
    "ORDER_TRACKING": ("number", False, "order_or_tracking_number"), "SERIAL": ("number", False, "product_serial"), "ADDRESS": ("postal_address", True, None),
    "ADDRESS_CORPORATE": ("postal_address", False, None), "DATE_OF_BIRTH": ("date_of_birth", True, None), "EMPLOYMENT": ("employment_info", True, None),
    "HANDLE": ("sns_handle", True, None), "HANDLE_BRAND": ("sns_handle", False, None), "IP_PERSONAL": ("ip_address", True, None), "IP_SERVER": ("ip_address", False, None),
    "MEMBER_ID": ("number", True, "member_or_customer"),
}
#: Span types that touching pieces may be joined in.
FAMILY = {"EMAIL": "email", "EMAIL_GENERIC": "email", "PHONE": "phone", "PHONE_CORPORATE": "phone", "ADDRESS": "address", "ADDRESS_CORPORATE": "address", "EMPLOYMENT": "employment", "IP_PERSONAL": "ip", "IP_SERVER": "ip", "HANDLE": "handle", "HANDLE_BRAND": "handle"}
# How a rule is reported (type, personal, number type, least level of the document).
RULE_REPORT = {
    "pii-email": ("email", True, None, "none"),
    "pii-credit-card": ("number", True, "credit_card", "high"),
    "pii-ssn": ("number", True, "national_id", "high"),
    "pii-mynumber-jp": ("number", True, "my_number", "high"),
    "pii-nir-fr": ("number", True, "national_id", "high"),
    "pii-codice-fiscale-it": ("number", True, "national_id", "high"),
    "pii-steuer-id-de": ("number", True, "national_id", "high"),
    "pii-dni-nie-es": ("number", True, "national_id", "high"),
    "pii-rrn-kr": ("number", True, "national_id", "high"),
    "pii-resident-id-cn": ("number", True, "national_id", "high"),
    "pii-brn-kr": ("number", False, "business_registration", "none"),
    "pii-postal-jp": ("postal_code", True, None, "none"),
    "pii-postal-code": ("postal_code", True, None, "none"),
    "pii-postal-cn": ("postal_code", True, None, "none"),
    "pii-ipv4-public": ("ip_address", True, None, "none"),
    "pii-ipv6": ("ip_address", True, None, "none"),
    "pii-iban": ("number", True, "bank_account", "high"),
    "pii-phone-intl": ("phone", True, None, "none"),
    "pii-nino-uk": ("number", True, "national_id", "high"),
    "pii-phone-us": ("phone", True, None, "none"),
    "pii-phone-jp": ("phone", True, None, "none"),
    "pii-phone-fr": ("phone", True, None, "none"),
    "pii-phone-it": ("phone", True, None, "none"),
    "pii-phone-de": ("phone", True, None, "none"),
    "pii-phone-es": ("phone", True, None, "none"),
    "pii-phone-kr": ("phone", True, None, "none"),
    "pii-phone-cn": ("phone", True, None, "none"),
}

SPAN = "struct<start:int,end:int,kind:string>"
MATCH = "struct<rule:string,description:string,category:string,start:int,end:int,value:string,rule_ord:int,match_ord:int>"
FINDING = "struct<type:string,value:string,start:int,end:int,pii:boolean,label:string,number_type:string>"
SECRET = "struct<type:string,value:string,start:int,end:int,line:int,rule:string>"
SENSITIVITY = "struct<level:string,probabilities:map<string,double>>"
