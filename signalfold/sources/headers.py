"""Column headers and field names, read on the driver: which canonical field each column of a file holds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

# fixed values: the canonical fields, short names of some, and what the fields of a list of people may be called
COMPANY = ("name", "domain", "website", "linkedin_url", "location", "city", "state", "country", "industry", "employees", "description", "keywords")
PERSON = ("first_name", "last_name", "full_name", "title", "email", "email_status", "person_linkedin_url", "phone", "seniority", "department", "person_location", "person_city", "person_state", "person_country")
SIGNAL = ("signal_type", "signal_title", "signal_date", "signal_url", "signal_location", "signal_description", "signal_id")
FUNDING = ("funding_stage", "funding_date", "funding_amount", "funding_currency", "funding_total", "funding_url")
EXTRA = ("data.", "signal_data.", "person_data.")
ALIASES = {
    "company": "name", "organization": "name", "organisation": "name", "employer": "name", "employee_count": "employees", "num_employees": "employees", "headcount": "employees", "linkedin": "linkedin_url",
    "person_linkedin": "person_linkedin_url", "contact_linkedin": "person_linkedin_url", "person_name": "full_name", "contact_name": "full_name", "person_role": "title", "contact_role": "title",
    "funding_round": "funding_stage", "funding_type": "funding_stage",
}
IN_PEOPLE = {"linkedin_url": "person_linkedin_url", "linkedin": "person_linkedin_url", "location": "person_location", "city": "person_city", "state": "person_state", "country": "person_country", "name": "full_name", "role": "title"}

#: A header is an owner's word (- for none) and a noun. (owners, nouns) in order of preference; nouns come first.
Names = tuple[tuple[str, str], ...]
ROLES: dict[str, Names] = {
    "company": (("-", "company companyname"), ("-", "organization organizationname organisation organisationname"), ("account business employer", "-name name -"), ("hiring", "company organization organisation"), ("company", "nameforemails")),
    "domain": (("- company website companywebsite primary root email", "domain"),),
    "website": (("- company", "website websiteurl"), ("company", "url site"), ("-", "homepage web site")),
    "company_page": (("company organization", "linkedinurl linkedin linkedinpage linkedinprofile linkedinprofileurl"), ("linkedin", "companyurl companypage")),
    "page": (("linkedin", "url - profile link"),),
    "seat": (("company -", "headquarters hq"), ("company hq", "location"), ("company", "address")),
    "seat_city": (("company hq", "city"),),
    "seat_state": (("company hq", "state"), ("company", "region")),
    "seat_country": (("company hq", "country"), ("company", "countrycode")),
    "place": (("-", "location address fulladdress"),),
    "city": (("-", "city town"),),
    "state": (("-", "state region province stateprovince"),),
    "country": (("country", "- code name"),),
    "industry": (("- company", "industry"), ("-", "industries sector vertical category categoryname maincategory")),
    "employees": (("# - numberof noof num company estimatednum", "employees"), ("employee", "count size range"), ("company", "employeecount size headcount"), ("-", "headcount size employeesrange staffcount")),
    "about": (("company", "description about summary overview"), ("-", "shortdescription about overview")),
    "keywords": (("- company", "keywords"), ("-", "tags technologies specialties specialities")),
    "first_name": (("- contact person", "firstname"), ("-", "first givenname")),
    "last_name": (("- contact person", "lastname"), ("-", "last surname familyname")),
    "full_name": (("- contact person", "fullname"), ("contact person prospect lead", "name")),
    "email": (("-", "email emailaddress"), ("work business contact person primary direct professional", "email"), ("-", "email1")),
    "email_status": (("email", "status verificationstatus verification validation validity result"), ("-", "verificationstatus")),
    "profile": (("person contact", "linkedinurl linkedin"), ("linkedin", "profileurl profilelink"), ("-", "profileurl")),
    "person_title": (("person contact current currentjob", "title"), ("-", "currentposition designation")),
    "title": (("-", "title jobtitle position role"),),
    "phone": (("workdirect direct", "phone"), ("-", "directdial mobilephone mobile cellphone phone phonenumber workphone officephone corporatephone")),
    "company_phone": (("corporate company main", "phone"), ("company", "phonenumber")),
    "seniority": (("seniority", "- level"),),
    "department": (("-", "departments department jobfunction function"),),
    "signal_type": (("signal", "type -"),),
    "opening": (("-", "signaltitle vacancy vacancytitle positionname jobname jobposition opening postingtitle jobpostingtitle"), ("open", "role position"), ("hiring", "for")),
    "signal_url": (("signal job", "url"), ("job", "link postingurl postinglink"), ("posting apply application vacancy", "url"), ("apply", "link")),
    "signal_date": (("-", "signaldate dateposted"), ("posted", "- at date on"), ("-", "postingdate publishedat datepublished publishdate published listeddate jobposteddate")),
    "made_date": (("-", "created createdat date listed"),),
    "signal_place": (("signal job vacancy posting", "location"),),
    "signal_text": (("signal job vacancy posting", "description"),),
    "signal_id": (("signal job posting vacancy", "id"), ("job", "reference ref")),
    "of_place": (("reviews review", "count"), ("-", "numberofreviews totalscore placeid googleplaceid categoryname maincategory workinghours openinghours businessstatus googlemapsurl mapsurl pluscode locatedin")),
    "perhaps_place": (("-", "rating reviews averagerating latitude longitude lat lng cid googleid"),),
    "employment": (("-", "salary"), ("job employment contract", "type")),
    "funding_stage": (("latest last -", "fundingstage fundinground fundingtype"), ("latest", "funding")),
    "funding_amount": (("latest last -", "fundingamount roundamount"), ("-", "amountraised lastfundingroundamount")),
    "funding_date": (("-", "lastraisedat"), ("latest last -", "fundingdate"), ("last", "fundingat rounddate fundingon"), ("latest last", "fundingrounddate"), ("-", "dateraised raiseddate")),
    "funding_total": (("total", "funding fundingamount raised fundingusd"),),
}


def normalized(header: object) -> str:
    return re.sub("[^a-z0-9#]", "", str(header or "").lower())


def spellings(*roles: str) -> list[str]:
    """Headers of roles, most wanted first."""
    pairs = [(owner, noun) for r in roles for owners, nouns in ROLES[r] for noun in nouns.split() for owner in owners.split()]
    return list(dict.fromkeys((owner + noun).replace("-", "") for owner, noun in pairs))


def canonical(key: object, people: bool = False) -> str:
    """The canonical field that a mapping's key means; a ValueError for others, so that typing errors show at once."""
    raw = str(key).strip()
    k = re.sub(r"[\s-]+", "_", raw.lower())
    for prefix in EXTRA:
        if raw.lower().startswith(prefix) and len(raw) > len(prefix):
            return prefix + raw[len(prefix) :]
    if people and k in IN_PEOPLE:
        return IN_PEOPLE[k]
    if k in COMPANY + PERSON + SIGNAL + FUNDING:
        return k
    if k in ALIASES:
        return ALIASES[k]
    owner, _, rest = k.partition("_")
    if owner in ("company", "organization", "organisation", "org"):
        rest = ALIASES.get(rest, rest)
        if rest in COMPANY:
            return rest
    if owner in ("person", "contact"):
        for name in (rest, f"person_{rest}"):
            if name in PERSON:
                return name
    raise ValueError(f"unknown field {raw!r}: expected a canonical field, data.<key>, signal_data.<key> or person_data.<key>")


def paths(value: object) -> list[str]:
    """A mapping's value as a list of paths; none switch the field off."""
    if value is None or value is False:
        return []
    values = value if isinstance(value, (list, tuple)) else [value]
    return [str(v) for v in values if v is not None and str(v).strip()]


def normal_mapping(mapping: Mapping | None, people: bool = False) -> dict[str, list[str]]:
    return {canonical(k, people): paths(v) for k, v in (mapping or {}).items()}


def merged(*mappings: Mapping | None) -> dict[str, list[str]]:
    """Later mappings replace earlier ones field by field."""
    out: dict[str, list[str]] = {}
    for m in mappings:
        out |= normal_mapping(m)
    return out


def resolved(overrides: Mapping | None, headers: Iterable[str]) -> dict[str, list[str]]:
    """A user's mapping with headers as the file writes them; what is no header stays a path."""
    headers = list(headers)
    known: dict[str, str] = {}
    for h in headers:
        known.setdefault(normalized(h), h)
    return {f: [p if p in headers else known.get(normalized(p), p) for p in ps] for f, ps in normal_mapping(overrides).items()}


class Detected(NamedTuple):
    mapping: dict[str, list[str]]
    mode: str
    signal_type: str | None
    unmapped: list[str]


def detected(headers: Iterable[str]) -> Detected:
    """What the columns of a file hold, by their headers.

    A file with people in it (mode people) has Title and LinkedIn URL of the person; otherwise a title is that of a job
    (mode jobs) and the page is the company's. City, State and so on are the company's unless columns of its seat exist,
    as then they are the person's. Files of places (reviews, opening hours) have the business's name as Title or Name.
    """
    known: dict[str, str] = {}
    for h in headers:
        if n := normalized(h):
            known.setdefault(n, h)
    taken: set[str] = set()
    mapping: dict[str, list[str]] = {}

    def there(*names: str) -> list[str]:
        return [known[n] for n in names if n in known]

    def has(*roles: str) -> bool:
        return bool(there(*spellings(*roles)))

    def take(field: str, names: list[str], every: bool = False) -> bool:
        """Give the field the first free column of these names, or all."""
        if field not in mapping:
            free = [h for h in there(*names) if h not in taken]
            if free:
                mapping[field] = free if every else free[:1]
                taken.update(mapping[field])
        return field in mapping

    named_people, people = has("first_name", "last_name", "full_name"), has("first_name", "last_name", "full_name", "email")
    business = None
    if (has("of_place") or len(there(*spellings("perhaps_place"))) > 1) and not has("company") and not named_people:
        if "name" in known and not has("person_title", "profile", "seniority", "department", "title"):
            business = "name"
        elif "title" in known and "name" not in known and not has("opening", "signal_url", "signal_date", "signal_text", "signal_id", "employment") and not there("jobtitle", "position", "role"):
            business = "title"
    people = people or ("name" in known and has("company"))
    titles = [h for h in there(*spellings("title", "opening")) if business is None or h != known[business]]
    mode = "people" if people else "jobs" if titles else "companies"

    if not take("name", spellings("company"), every=True):
        take("name", [business] if business else ["name"] if not people else [])
    take("domain", spellings("domain"))
    take("website", spellings("website") + (["url", "link"] if mode == "companies" else []))
    take("linkedin_url", spellings("company_page") + (spellings("page") if mode != "people" else []))
    if people:
        for field, names in (("first_name", spellings("first_name")), ("last_name", spellings("last_name")), ("full_name", [*spellings("full_name"), "name"]), ("email", spellings("email")), ("email_status", spellings("email_status")), ("person_linkedin_url", spellings("profile", "page")), ("title", spellings("person_title", "title"))):
            take(field, names)
        take("phone", spellings("phone"), every=True)
        take("seniority", spellings("seniority"))
        take("department", spellings("department"))
    if has("company_phone"):
        mapping["data.phone"] = there(*spellings("company_phone"))[:1]

    seat = {"location": "seat", "city": "seat_city", "state": "seat_state", "country": "seat_country"}
    seated = people and has(*seat.values())
    for field, role in seat.items():
        take(field, spellings(role))
    for field, role in zip(seat, ("place", "city", "state", "country"), strict=True):
        take(f"person_{field}" if seated else field, spellings(role))
    for field in ("industry", "employees", "keywords", "signal_type"):
        take(field, spellings(field))

    posting = mode == "jobs"
    if posting:
        take("signal_title", ["signaltitle", *spellings("title", "opening")])
        take("signal_url", [*spellings("signal_url"), "url", "link"])
        take("signal_date", spellings("signal_date", "made_date"))
        take("signal_description", [*spellings("signal_text"), "description"])
        take("signal_id", [*spellings("signal_id"), "id", "reference"])
        if not take("signal_location", spellings("signal_place", "place")) and "location" in mapping:
            mapping["signal_location"] = list(mapping["location"])
    else:
        if not take("signal_title", spellings("opening")) and people:
            posting = take("signal_title", spellings("title"))  # a second title is that of the opening
        for field, role in (("signal_url", "signal_url"), ("signal_date", "signal_date"), ("signal_description", "signal_text"), ("signal_id", "signal_id"), ("signal_location", "signal_place")):
            take(field, spellings(role))
    take("description", spellings("about") + (["description", "summary"] if mode != "jobs" else []))
    for field in ("funding_stage", "funding_amount", "funding_date", "funding_total"):
        take(field, spellings(field))
    used = {h for found in mapping.values() for h in found}
    return Detected(mapping, mode, "job_posting" if posting else None, [h for h in known.values() if h not in used])
