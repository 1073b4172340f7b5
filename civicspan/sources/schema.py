"""Declared tables: columns in file order, types, keys and references.

Files bind to these columns by position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

TYPES: dict[str, DataType] = {
    "smallint": ShortType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "decimal(18,6)": DecimalType(18, 6),
    "date": DateType(),
    "timestamp_ntz": TimestampNTZType(),
}

# Each table with its key columns, then its columns in file order.
DECLARED_TABLES = """
agencies (agency_id)
  yearly_agency_id int
  agency_id int
  data_year int
  ori varchar(25)
  legacy_ori varchar(25)
  covered_by_legacy_ori varchar(25)
  direct_contributor_flag varchar(1)
  dormant_flag varchar(1)
  dormant_year int
  reporting_type varchar(1)
  ucr_agency_name varchar(100)
  ncic_agency_name varchar(100)
  pub_agency_name varchar(100)
  pub_agency_unit varchar(100)
  agency_status varchar(1)
  state_id int
  state_name varchar(100)
  state_abbr varchar(2)
  state_postal_abbr varchar(2)
  division_code int
  division_name varchar(100)
  region_code int
  region_name varchar(100)
  region_desc varchar(100)
  agency_type_name varchar(100)
  population int
  submitting_agency_id int
  sai varchar(25)
  submitting_agency_name varchar(200)
  suburban_area_flag varchar(1)
  population_group_id int
  population_group_code varchar(2)
  population_group_desc varchar(100)
  parent_pop_group_code int
  parent_pop_group_desc varchar(100)
  mip_flag varchar(1)
  pop_sort_order int
  summary_rape_def varchar(1)
  pe_reported_flag varchar(1)
  male_officer int
  male_civilian int
  male_total int
  female_officer int
  female_civilian int
  female_total int
  officer_rate decimal(18,6)
  employee_rate decimal(18,6)
  nibrs_cert_date date
  nibrs_start_date date
  nibrs_leoka_start_date date
  nibrs_ct_start_date date
  nibrs_multi_bias_start_date date
  nibrs_off_eth_start_date date
  covered_flag varchar(1)
  county_name varchar(100)
  msa_name varchar(100)
  publishable_flag varchar(1)
  participated varchar(1)
  nibrs_participated varchar(1)
nibrs_activity_type (activity_type_id)
  activity_type_id smallint not null
  activity_type_code char(2)
  activity_type_name varchar(100)
nibrs_age (age_id)
  age_id smallint not null
  age_code char(2)
  age_name varchar(100)
nibrs_arrest_type (arrest_type_id)
  arrest_type_id smallint not null
  arrest_type_code char(1)
  arrest_type_name varchar(100)
nibrs_assignment_type (assignment_type_id)
  assignment_type_id smallint not null
  assignment_type_code char(1)
  assignment_type_name varchar(100)
nibrs_bias_list (bias_id)
  bias_id smallint not null
  bias_code char(2)
  bias_name varchar(100)
  bias_desc varchar(100)
nibrs_location_type (location_id)
  location_id bigint not null
  location_code char(2)
  location_name varchar(100)
nibrs_prop_desc_type (prop_desc_id)
  prop_desc_id smallint not null
  prop_desc_name varchar(100)
  prop_desc_code char(2)
nibrs_victim_type (victim_type_id)
  victim_type_id smallint not null
  victim_type_code char(1)
  victim_type_name varchar(100)
nibrs_circumstances (circumstances_id)
  circumstances_id smallint not null
  circumstances_type char(1)
  circumstances_code smallint
  circumstances_name varchar(100)
nibrs_cleared_except (cleared_except_id)
  cleared_except_id smallint not null
  cleared_except_code char(1)
  cleared_except_name varchar(100)
  cleared_except_desc varchar(300)
nibrs_criminal_act_type (criminal_act_id)
  criminal_act_id smallint not null
  criminal_act_code char(1)
  criminal_act_name varchar(100)
  criminal_act_desc varchar(300)
nibrs_drug_measure_type (drug_measure_type_id)
  drug_measure_type_id smallint not null
  drug_measure_code char(2)
  drug_measure_name varchar(100)
nibrs_ethnicity (ethnicity_id)
  ethnicity_id smallint not null
  ethnicity_code char(1)
  ethnicity_name varchar(100)
nibrs_injury (injury_id)
  injury_id smallint not null
  injury_code char(1)
  injury_name varchar(100)
nibrs_justifiable_force (justifiable_force_id)
  justifiable_force_id smallint not null
  justifiable_force_code char(1)
  justifiable_force_name varchar(100)
nibrs_prop_loss_type (prop_loss_id)
  prop_loss_id smallint not null
  prop_loss_name varchar(100)
  prop_loss_desc varchar(250)
nibrs_relationship (relationship_id)
  relationship_id smallint not null
  relationship_code char(2)
  relationship_name varchar(100)
nibrs_suspected_drug_type (suspected_drug_type_id)
  suspected_drug_type_id smallint not null
  suspected_drug_code char(1)
  suspected_drug_name varchar(100)
nibrs_using_list (suspect_using_id)
  suspect_using_id smallint not null
  suspect_using_code char(1)
  suspect_using_name varchar(100)
nibrs_offense_type (offense_code)
  offense_code varchar(5) not null
  offense_name varchar(100)
  crime_against varchar(100)
  ct_flag char(1)
  hc_flag char(1)
  hc_code varchar(5)
  offense_category_name varchar(100)
  offense_group char(5)
nibrs_weapon_type (weapon_id)
  weapon_id smallint not null
  weapon_code varchar(3)
  weapon_name varchar(100)
  shr_flag char(1)
ref_race (race_id)
  race_id smallint not null
  race_code varchar(2) not null
  race_desc varchar(100) not null
  sort_order smallint
  start_year smallint
  end_year smallint
  notes varchar(1000)
ref_state (state_id)
  state_id smallint not null
  division_id smallint not null
  state_name varchar(100)
  state_code varchar(2)
  state_abbr varchar(2)
  state_postal_abbr varchar(2)
  state_fips_code varchar(2)
  state_pub_freq_months smallint
  change_user varchar(100)
nibrs_month (did)
  data_year int
  nibrs_month_id bigint not null
  agency_id bigint not null
  month_num smallint not null
  inc_data_year int
  reported_status varchar(10)
  report_date timestamp_ntz
  update_flag char(1)
  orig_format char(1) not null
  data_home varchar(10)
  ddocname varchar(50)
  did bigint
  month_pub_status int
nibrs_incident (incident_id)
  data_year int
  agency_id bigint not null
  incident_id bigint not null
  nibrs_month_id bigint not null
  cargo_theft_flag char(1)
  submission_date timestamp_ntz
  incident_date timestamp_ntz
  report_date_flag char(1)
  incident_hour smallint
  cleared_except_id smallint not null
  cleared_except_date timestamp_ntz
  incident_status varchar(100)
  data_home char(1)
  orig_format char(1)
  did bigint
nibrs_offender (offender_id)
  data_year int
  offender_id bigint not null
  incident_id bigint not null
  offender_seq_num smallint
  age_id smallint
  age_num char(3)
  sex_code char(1)
  race_id smallint
  ethnicity_id smallint
  age_range_low_num smallint
  age_range_high_num smallint
nibrs_offense (offense_id)
  data_year int
  offense_id bigint not null
  incident_id bigint not null
  offense_code varchar(5) not null
  attempt_complete_flag char(1)
  location_id bigint not null
  num_premises_entered smallint
  method_entry_code char(1)
nibrs_arrestee (arrestee_id)
  data_year int
  arrestee_id bigint not null
  incident_id bigint not null
  arrestee_seq_num bigint
  arrest_date timestamp_ntz
  arrest_type_id smallint
  multiple_indicator char(1)
  offense_code varchar(5) not null
  age_id smallint not null
  age_num smallint
  sex_code char(1)
  race_id smallint not null
  ethnicity_id smallint
  resident_code char(1)
  under_18_disposition_code char(1)
  clearance_ind char(1)
  age_range_low_num smallint
  age_range_high_num smallint
nibrs_property (property_id)
  data_year int
  property_id bigint not null
  incident_id bigint not null
  prop_loss_id smallint not null
  stolen_count smallint
  recovered_count smallint
nibrs_victim (victim_id)
  data_year int
  victim_id bigint not null
  incident_id bigint not null
  victim_seq_num smallint
  victim_type_id smallint not null
  assignment_type_id smallint
  activity_type_id smallint
  outside_agency_id bigint
  age_id smallint
  age_num smallint
  sex_code char(1)
  race_id smallint
  ethnicity_id smallint
  resident_status_code char(1)
  age_range_low_num smallint
  age_range_high_num smallint
nibrs_suspected_drug (nibrs_suspected_drug_id)
  data_year int
  suspected_drug_type_id smallint not null
  property_id bigint not null
  est_drug_qty double
  drug_measure_type_id smallint
  nibrs_suspected_drug_id bigint not null
nibrs_property_desc (property_id, prop_desc_id)
  data_year int
  property_id bigint not null
  prop_desc_id smallint not null
  property_value bigint
  date_recovered timestamp_ntz
  nibrs_prop_desc_id bigint
nibrs_arrestee_weapon (arrestee_id, weapon_id)
  data_year int
  arrestee_id bigint not null
  nibrs_arrestee_weapon_id bigint
  weapon_id smallint not null
nibrs_victim_circumstances (victim_id, circumstances_id)
  data_year int
  victim_id bigint not null
  circumstances_id smallint not null
  justifiable_force_id smallint
nibrs_victim_offender_rel (victim_id, offender_id)
  data_year int
  victim_id bigint not null
  offender_id bigint not null
  relationship_id smallint not null
  nibrs_victim_offender_id bigint
nibrs_weapon (weapon_id, offense_id)
  data_year int
  weapon_id smallint not null
  offense_id bigint not null
  nibrs_weapon_id bigint
nibrs_criminal_act (criminal_act_id, offense_id)
  data_year int
  criminal_act_id smallint not null
  offense_id bigint not null
nibrs_bias_motivation (bias_id, offense_id)
  data_year int
  bias_id smallint not null
  offense_id bigint not null
nibrs_suspect_using (suspect_using_id, offense_id)
  data_year int
  suspect_using_id smallint not null
  offense_id bigint not null
nibrs_victim_injury (victim_id, injury_id)
  data_year int
  victim_id bigint not null
  injury_id smallint not null
nibrs_victim_offense (victim_id, offense_id)
  data_year int
  victim_id bigint not null
  offense_id bigint not null
"""

# References; with "cascade", a row goes when the row it refers to goes.
DECLARED_REFERENCES = """
nibrs_month.agency_id -> agencies.agency_id
nibrs_incident.agency_id -> agencies.agency_id
nibrs_incident.cleared_except_id -> nibrs_cleared_except.cleared_except_id
nibrs_incident.did -> nibrs_month.did cascade
nibrs_offender.incident_id -> nibrs_incident.incident_id cascade
nibrs_offender.age_id -> nibrs_age.age_id
nibrs_offender.race_id -> ref_race.race_id
nibrs_offender.ethnicity_id -> nibrs_ethnicity.ethnicity_id
nibrs_offense.incident_id -> nibrs_incident.incident_id cascade
nibrs_offense.offense_code -> nibrs_offense_type.offense_code
nibrs_offense.location_id -> nibrs_location_type.location_id
nibrs_arrestee.incident_id -> nibrs_incident.incident_id cascade
nibrs_arrestee.arrest_type_id -> nibrs_arrest_type.arrest_type_id
nibrs_arrestee.offense_code -> nibrs_offense_type.offense_code
nibrs_arrestee.age_id -> nibrs_age.age_id
nibrs_arrestee.race_id -> ref_race.race_id
nibrs_arrestee.ethnicity_id -> nibrs_ethnicity.ethnicity_id
nibrs_property.incident_id -> nibrs_incident.incident_id cascade
nibrs_property.prop_loss_id -> nibrs_prop_loss_type.prop_loss_id
nibrs_victim.incident_id -> nibrs_incident.incident_id cascade
nibrs_victim.victim_type_id -> nibrs_victim_type.victim_type_id
nibrs_victim.assignment_type_id -> nibrs_assignment_type.assignment_type_id
nibrs_victim.activity_type_id -> nibrs_activity_type.activity_type_id
nibrs_victim.age_id -> nibrs_age.age_id
nibrs_victim.race_id -> ref_race.race_id
nibrs_victim.ethnicity_id -> nibrs_ethnicity.ethnicity_id
nibrs_suspected_drug.suspected_drug_type_id -> nibrs_suspected_drug_type.suspected_drug_type_id
nibrs_suspected_drug.property_id -> nibrs_property.property_id cascade
nibrs_suspected_drug.drug_measure_type_id -> nibrs_drug_measure_type.drug_measure_type_id
nibrs_property_desc.property_id -> nibrs_property.property_id cascade
nibrs_property_desc.prop_desc_id -> nibrs_prop_desc_type.prop_desc_id
nibrs_arrestee_weapon.arrestee_id -> nibrs_arrestee.arrestee_id cascade
nibrs_arrestee_weapon.weapon_id -> nibrs_weapon_type.weapon_id
nibrs_victim_circumstances.victim_id -> nibrs_victim.victim_id cascade
nibrs_victim_circumstances.circumstances_id -> nibrs_circumstances.circumstances_id
nibrs_victim_circumstances.justifiable_force_id -> nibrs_justifiable_force.justifiable_force_id
nibrs_victim_offender_rel.victim_id -> nibrs_victim.victim_id cascade
nibrs_victim_offender_rel.offender_id -> nibrs_offender.offender_id cascade
nibrs_victim_offender_rel.relationship_id -> nibrs_relationship.relationship_id
nibrs_weapon.weapon_id -> nibrs_weapon_type.weapon_id
nibrs_weapon.offense_id -> nibrs_offense.offense_id cascade
nibrs_criminal_act.criminal_act_id -> nibrs_criminal_act_type.criminal_act_id
nibrs_criminal_act.offense_id -> nibrs_offense.offense_id cascade
nibrs_bias_motivation.bias_id -> nibrs_bias_list.bias_id
nibrs_bias_motivation.offense_id -> nibrs_offense.offense_id cascade
nibrs_suspect_using.suspect_using_id -> nibrs_using_list.suspect_using_id
nibrs_suspect_using.offense_id -> nibrs_offense.offense_id cascade
nibrs_victim_injury.victim_id -> nibrs_victim.victim_id cascade
nibrs_victim_injury.injury_id -> nibrs_injury.injury_id
nibrs_victim_offense.victim_id -> nibrs_victim.victim_id cascade
nibrs_victim_offense.offense_id -> nibrs_offense.offense_id cascade
"""

# Tables of one drop's rows, as opposed to code tables.
FACT_TABLES = [
    "nibrs_month",
    "nibrs_incident",
    "nibrs_offender",
    "nibrs_offense",
    "nibrs_arrestee",
    "nibrs_property",
    "nibrs_victim",
    "nibrs_suspected_drug",
    "nibrs_property_desc",
    "nibrs_arrestee_weapon",
    "nibrs_victim_circumstances",
    "nibrs_victim_offender_rel",
    "nibrs_weapon",
    "nibrs_criminal_act",
    "nibrs_bias_motivation",
    "nibrs_suspect_using",
    "nibrs_victim_injury",
    "nibrs_victim_offense",
]

#: Declared with one key, but filled with a row for each year.
YEARLY_TABLES = {"agencies"}

COMMENTS = {
    "orig_format": "How the report first came in: F flat file, W web form, U or S data "
    "exchange by upload or service, B process engine, N not known, M several in one month",
}


@dataclass(frozen=True)
class Table:
    """One declared table: Spark schema and key columns."""

    name: str
    schema: StructType
    key: tuple[str, ...]
    is_fact: bool

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def row_key(self) -> tuple[str, ...]:
        """The columns that tell rows apart once several years are loaded."""
        return (*self.key, "data_year") if self.name in YEARLY_TABLES else self.key

    def required(self) -> list[str]:
        """Columns that must be filled: declared so, or part of the key."""
        return [f.name for f in self.schema if f.metadata.get("required") or f.name in self.row_key]

    def lengths(self) -> dict[str, int]:
        return {f.name: f.metadata["max_len"] for f in self.schema if "max_len" in f.metadata}

    def padded(self) -> list[str]:
        return [f.name for f in self.schema if f.metadata.get("padded")]


@dataclass(frozen=True)
class Reference:
    """``child.column`` must occur in ``parent.parent_column``."""

    child: str
    column: str
    parent: str
    parent_column: str
    cascade: bool


def _field(line: str) -> StructField:
    name, kind, *rest = line.split()
    metadata: dict = {"required": True} if rest == ["not", "null"] else {}
    if name in COMMENTS:
        metadata["comment"] = COMMENTS[name]
    text = re.fullmatch(r"(varchar|char)\((\d+)\)", kind)
    if text:
        metadata["max_len"] = int(text.group(2))
        if text.group(1) == "char":
            metadata["padded"] = True
        return StructField(name, StringType(), True, metadata)
    return StructField(name, TYPES[kind], True, metadata)


def _table(block: str) -> Table:
    head, *lines = block.splitlines()
    name, key = re.fullmatch(r"(\w+) \((.*)\)", head).groups()
    return Table(name, StructType([_field(line) for line in lines]), tuple(key.split(", ")), name in FACT_TABLES)


def _reference(line: str) -> Reference:
    child, column, parent, parent_column, cascade = re.fullmatch(
        r"(\w+)\.(\w+) -> (\w+)\.(\w+)( cascade)?", line
    ).groups()
    return Reference(child, column, parent, parent_column, bool(cascade))


REGISTRY: dict[str, Table] = {
    table.name: table for table in map(_table, re.split(r"\n(?=\S)", DECLARED_TABLES.strip()))
}
REFERENCES: list[Reference] = [_reference(line) for line in DECLARED_REFERENCES.strip().splitlines()]
