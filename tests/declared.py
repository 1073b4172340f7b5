"""The declared columns and references, written out for comparison with the package."""

# Columns in file order, with type, "not null" and place in the key.
COLUMNS = """
agencies.yearly_agency_id int
agencies.agency_id int key 1
agencies.data_year int
agencies.ori varchar(25)
agencies.legacy_ori varchar(25)
agencies.covered_by_legacy_ori varchar(25)
agencies.direct_contributor_flag varchar(1)
agencies.dormant_flag varchar(1)
agencies.dormant_year int
agencies.reporting_type varchar(1)
agencies.ucr_agency_name varchar(100)
agencies.ncic_agency_name varchar(100)
agencies.pub_agency_name varchar(100)
agencies.pub_agency_unit varchar(100)
agencies.agency_status varchar(1)
agencies.state_id int
agencies.state_name varchar(100)
agencies.state_abbr varchar(2)
agencies.state_postal_abbr varchar(2)
agencies.division_code int
agencies.division_name varchar(100)
agencies.region_code int
agencies.region_name varchar(100)
agencies.region_desc varchar(100)
agencies.agency_type_name varchar(100)
agencies.population int
agencies.submitting_agency_id int
agencies.sai varchar(25)
agencies.submitting_agency_name varchar(200)
agencies.suburban_area_flag varchar(1)
agencies.population_group_id int
agencies.population_group_code varchar(2)
agencies.population_group_desc varchar(100)
agencies.parent_pop_group_code int
agencies.parent_pop_group_desc varchar(100)
agencies.mip_flag varchar(1)
agencies.pop_sort_order int
agencies.summary_rape_def varchar(1)
agencies.pe_reported_flag varchar(1)
agencies.male_officer int
agencies.male_civilian int
agencies.male_total int
agencies.female_officer int
agencies.female_civilian int
agencies.female_total int
agencies.officer_rate decimal(18,6)
agencies.employee_rate decimal(18,6)
agencies.nibrs_cert_date date
agencies.nibrs_start_date date
agencies.nibrs_leoka_start_date date
agencies.nibrs_ct_start_date date
agencies.nibrs_multi_bias_start_date date
agencies.nibrs_off_eth_start_date date
agencies.covered_flag varchar(1)
agencies.county_name varchar(100)
agencies.msa_name varchar(100)
agencies.publishable_flag varchar(1)
agencies.participated varchar(1)
agencies.nibrs_participated varchar(1)
nibrs_activity_type.activity_type_id smallint not null key 1
nibrs_activity_type.activity_type_code char(2)
nibrs_activity_type.activity_type_name varchar(100)
nibrs_age.age_id smallint not null key 1
nibrs_age.age_code char(2)
nibrs_age.age_name varchar(100)
nibrs_arrest_type.arrest_type_id smallint not null key 1
nibrs_arrest_type.arrest_type_code char(1)
nibrs_arrest_type.arrest_type_name varchar(100)
nibrs_assignment_type.assignment_type_id smallint not null key 1
nibrs_assignment_type.assignment_type_code char(1)
nibrs_assignment_type.assignment_type_name varchar(100)
nibrs_bias_list.bias_id smallint not null key 1
nibrs_bias_list.bias_code char(2)
nibrs_bias_list.bias_name varchar(100)
nibrs_bias_list.bias_desc varchar(100)
nibrs_location_type.location_id bigint not null key 1
nibrs_location_type.location_code char(2)
nibrs_location_type.location_name varchar(100)
nibrs_prop_desc_type.prop_desc_id smallint not null key 1
nibrs_prop_desc_type.prop_desc_name varchar(100)
nibrs_prop_desc_type.prop_desc_code char(2)
nibrs_victim_type.victim_type_id smallint not null key 1
nibrs_victim_type.victim_type_code char(1)
nibrs_victim_type.victim_type_name varchar(100)
nibrs_circumstances.circumstances_id smallint not null key 1
nibrs_circumstances.circumstances_type char(1)
nibrs_circumstances.circumstances_code smallint
nibrs_circumstances.circumstances_name varchar(100)
nibrs_cleared_except.cleared_except_id smallint not null key 1
nibrs_cleared_except.cleared_except_code char(1)
nibrs_cleared_except.cleared_except_name varchar(100)
nibrs_cleared_except.cleared_except_desc varchar(300)
nibrs_criminal_act_type.criminal_act_id smallint not null key 1
nibrs_criminal_act_type.criminal_act_code char(1)
nibrs_criminal_act_type.criminal_act_name varchar(100)
nibrs_criminal_act_type.criminal_act_desc varchar(300)
nibrs_drug_measure_type.drug_measure_type_id smallint not null key 1
nibrs_drug_measure_type.drug_measure_code char(2)
nibrs_drug_measure_type.drug_measure_name varchar(100)
nibrs_ethnicity.ethnicity_id smallint not null key 1
nibrs_ethnicity.ethnicity_code char(1)
nibrs_ethnicity.ethnicity_name varchar(100)
nibrs_injury.injury_id smallint not null key 1
nibrs_injury.injury_code char(1)
nibrs_injury.injury_name varchar(100)
nibrs_justifiable_force.justifiable_force_id smallint not null key 1
nibrs_justifiable_force.justifiable_force_code char(1)
nibrs_justifiable_force.justifiable_force_name varchar(100)
nibrs_prop_loss_type.prop_loss_id smallint not null key 1
nibrs_prop_loss_type.prop_loss_name varchar(100)
nibrs_prop_loss_type.prop_loss_desc varchar(250)
nibrs_relationship.relationship_id smallint not null key 1
nibrs_relationship.relationship_code char(2)
nibrs_relationship.relationship_name varchar(100)
nibrs_suspected_drug_type.suspected_drug_type_id smallint not null key 1
nibrs_suspected_drug_type.suspected_drug_code char(1)
nibrs_suspected_drug_type.suspected_drug_name varchar(100)
nibrs_using_list.suspect_using_id smallint not null key 1
nibrs_using_list.suspect_using_code char(1)
nibrs_using_list.suspect_using_name varchar(100)
nibrs_offense_type.offense_code varchar(5) not null key 1
nibrs_offense_type.offense_name varchar(100)
nibrs_offense_type.crime_against varchar(100)
nibrs_offense_type.ct_flag char(1)
nibrs_offense_type.hc_flag char(1)
nibrs_offense_type.hc_code varchar(5)
nibrs_offense_type.offense_category_name varchar(100)
nibrs_offense_type.offense_group char(5)
nibrs_weapon_type.weapon_id smallint not null key 1
nibrs_weapon_type.weapon_code varchar(3)
nibrs_weapon_type.weapon_name varchar(100)
nibrs_weapon_type.shr_flag char(1)
ref_race.race_id smallint not null key 1
ref_race.race_code varchar(2) not null
ref_race.race_desc varchar(100) not null
ref_race.sort_order smallint
ref_race.start_year smallint
ref_race.end_year smallint
ref_race.notes varchar(1000)
ref_state.state_id smallint not null key 1
ref_state.division_id smallint not null
ref_state.state_name varchar(100)
ref_state.state_code varchar(2)
ref_state.state_abbr varchar(2)
ref_state.state_postal_abbr varchar(2)
ref_state.state_fips_code varchar(2)
ref_state.state_pub_freq_months smallint
ref_state.change_user varchar(100)
nibrs_month.data_year int
nibrs_month.nibrs_month_id bigint not null
nibrs_month.agency_id bigint not null
nibrs_month.month_num smallint not null
nibrs_month.inc_data_year int
nibrs_month.reported_status varchar(10)
nibrs_month.report_date timestamp_ntz
nibrs_month.update_flag char(1)
nibrs_month.orig_format char(1) not null
nibrs_month.data_home varchar(10)
nibrs_month.ddocname varchar(50)
nibrs_month.did bigint key 1
nibrs_month.month_pub_status int
nibrs_incident.data_year int
nibrs_incident.agency_id bigint not null
nibrs_incident.incident_id bigint not null key 1
nibrs_incident.nibrs_month_id bigint not null
nibrs_incident.cargo_theft_flag char(1)
nibrs_incident.submission_date timestamp_ntz
nibrs_incident.incident_date timestamp_ntz
nibrs_incident.report_date_flag char(1)
nibrs_incident.incident_hour smallint
nibrs_incident.cleared_except_id smallint not null
nibrs_incident.cleared_except_date timestamp_ntz
nibrs_incident.incident_status varchar(100)
nibrs_incident.data_home char(1)
nibrs_incident.orig_format char(1)
nibrs_incident.did bigint
nibrs_offender.data_year int
nibrs_offender.offender_id bigint not null key 1
nibrs_offender.incident_id bigint not null
nibrs_offender.offender_seq_num smallint
nibrs_offender.age_id smallint
nibrs_offender.age_num char(3)
nibrs_offender.sex_code char(1)
nibrs_offender.race_id smallint
nibrs_offender.ethnicity_id smallint
nibrs_offender.age_range_low_num smallint
nibrs_offender.age_range_high_num smallint
nibrs_offense.data_year int
nibrs_offense.offense_id bigint not null key 1
nibrs_offense.incident_id bigint not null
nibrs_offense.offense_code varchar(5) not null
nibrs_offense.attempt_complete_flag char(1)
nibrs_offense.location_id bigint not null
nibrs_offense.num_premises_entered smallint
nibrs_offense.method_entry_code char(1)
nibrs_arrestee.data_year int
nibrs_arrestee.arrestee_id bigint not null key 1
nibrs_arrestee.incident_id bigint not null
nibrs_arrestee.arrestee_seq_num bigint
nibrs_arrestee.arrest_date timestamp_ntz
nibrs_arrestee.arrest_type_id smallint
nibrs_arrestee.multiple_indicator char(1)
nibrs_arrestee.offense_code varchar(5) not null
nibrs_arrestee.age_id smallint not null
nibrs_arrestee.age_num smallint
nibrs_arrestee.sex_code char(1)
nibrs_arrestee.race_id smallint not null
nibrs_arrestee.ethnicity_id smallint
nibrs_arrestee.resident_code char(1)
nibrs_arrestee.under_18_disposition_code char(1)
nibrs_arrestee.clearance_ind char(1)
nibrs_arrestee.age_range_low_num smallint
nibrs_arrestee.age_range_high_num smallint
nibrs_property.data_year int
nibrs_property.property_id bigint not null key 1
nibrs_property.incident_id bigint not null
nibrs_property.prop_loss_id smallint not null
nibrs_property.stolen_count smallint
nibrs_property.recovered_count smallint
nibrs_victim.data_year int
nibrs_victim.victim_id bigint not null key 1
nibrs_victim.incident_id bigint not null
nibrs_victim.victim_seq_num smallint
nibrs_victim.victim_type_id smallint not null
nibrs_victim.assignment_type_id smallint
nibrs_victim.activity_type_id smallint
nibrs_victim.outside_agency_id bigint
nibrs_victim.age_id smallint
nibrs_victim.age_num smallint
nibrs_victim.sex_code char(1)
nibrs_victim.race_id smallint
nibrs_victim.ethnicity_id smallint
nibrs_victim.resident_status_code char(1)
nibrs_victim.age_range_low_num smallint
nibrs_victim.age_range_high_num smallint
nibrs_suspected_drug.data_year int
nibrs_suspected_drug.suspected_drug_type_id smallint not null
nibrs_suspected_drug.property_id bigint not null
nibrs_suspected_drug.est_drug_qty double
nibrs_suspected_drug.drug_measure_type_id smallint
nibrs_suspected_drug.nibrs_suspected_drug_id bigint not null key 1
nibrs_property_desc.data_year int
nibrs_property_desc.property_id bigint not null key 1
nibrs_property_desc.prop_desc_id smallint not null key 2
nibrs_property_desc.property_value bigint
nibrs_property_desc.date_recovered timestamp_ntz
nibrs_property_desc.nibrs_prop_desc_id bigint
nibrs_arrestee_weapon.data_year int
nibrs_arrestee_weapon.arrestee_id bigint not null key 1
nibrs_arrestee_weapon.nibrs_arrestee_weapon_id bigint
nibrs_arrestee_weapon.weapon_id smallint not null key 2
nibrs_victim_circumstances.data_year int
nibrs_victim_circumstances.victim_id bigint not null key 1
nibrs_victim_circumstances.circumstances_id smallint not null key 2
nibrs_victim_circumstances.justifiable_force_id smallint
nibrs_victim_offender_rel.data_year int
nibrs_victim_offender_rel.victim_id bigint not null key 1
nibrs_victim_offender_rel.offender_id bigint not null key 2
nibrs_victim_offender_rel.relationship_id smallint not null
nibrs_victim_offender_rel.nibrs_victim_offender_id bigint
nibrs_weapon.data_year int
nibrs_weapon.weapon_id smallint not null key 1
nibrs_weapon.offense_id bigint not null key 2
nibrs_weapon.nibrs_weapon_id bigint
nibrs_criminal_act.data_year int
nibrs_criminal_act.criminal_act_id smallint not null key 1
nibrs_criminal_act.offense_id bigint not null key 2
nibrs_bias_motivation.data_year int
nibrs_bias_motivation.bias_id smallint not null key 1
nibrs_bias_motivation.offense_id bigint not null key 2
nibrs_suspect_using.data_year int
nibrs_suspect_using.suspect_using_id smallint not null key 1
nibrs_suspect_using.offense_id bigint not null key 2
nibrs_victim_injury.data_year int
nibrs_victim_injury.victim_id bigint not null key 1
nibrs_victim_injury.injury_id smallint not null key 2
nibrs_victim_offense.data_year int
nibrs_victim_offense.victim_id bigint not null key 1
nibrs_victim_offense.offense_id bigint not null key 2
"""

# References, and whether rows go with the row they refer to.
REFERENCES = """
nibrs_month.agency_id agencies.agency_id
nibrs_incident.agency_id agencies.agency_id
nibrs_incident.cleared_except_id nibrs_cleared_except.cleared_except_id
nibrs_incident.did nibrs_month.did cascade
nibrs_offender.incident_id nibrs_incident.incident_id cascade
nibrs_offender.age_id nibrs_age.age_id
nibrs_offender.race_id ref_race.race_id
nibrs_offender.ethnicity_id nibrs_ethnicity.ethnicity_id
nibrs_offense.incident_id nibrs_incident.incident_id cascade
nibrs_offense.offense_code nibrs_offense_type.offense_code
nibrs_offense.location_id nibrs_location_type.location_id
nibrs_arrestee.incident_id nibrs_incident.incident_id cascade
nibrs_arrestee.arrest_type_id nibrs_arrest_type.arrest_type_id
nibrs_arrestee.offense_code nibrs_offense_type.offense_code
nibrs_arrestee.age_id nibrs_age.age_id
nibrs_arrestee.race_id ref_race.race_id
nibrs_arrestee.ethnicity_id nibrs_ethnicity.ethnicity_id
nibrs_property.incident_id nibrs_incident.incident_id cascade
nibrs_property.prop_loss_id nibrs_prop_loss_type.prop_loss_id
nibrs_victim.incident_id nibrs_incident.incident_id cascade
nibrs_victim.victim_type_id nibrs_victim_type.victim_type_id
nibrs_victim.assignment_type_id nibrs_assignment_type.assignment_type_id
nibrs_victim.activity_type_id nibrs_activity_type.activity_type_id
nibrs_victim.age_id nibrs_age.age_id
nibrs_victim.race_id ref_race.race_id
nibrs_victim.ethnicity_id nibrs_ethnicity.ethnicity_id
nibrs_suspected_drug.suspected_drug_type_id nibrs_suspected_drug_type.suspected_drug_type_id
nibrs_suspected_drug.property_id nibrs_property.property_id cascade
nibrs_suspected_drug.drug_measure_type_id nibrs_drug_measure_type.drug_measure_type_id
nibrs_property_desc.property_id nibrs_property.property_id cascade
nibrs_property_desc.prop_desc_id nibrs_prop_desc_type.prop_desc_id
nibrs_arrestee_weapon.arrestee_id nibrs_arrestee.arrestee_id cascade
nibrs_arrestee_weapon.weapon_id nibrs_weapon_type.weapon_id
nibrs_victim_circumstances.victim_id nibrs_victim.victim_id cascade
nibrs_victim_circumstances.circumstances_id nibrs_circumstances.circumstances_id
nibrs_victim_circumstances.justifiable_force_id nibrs_justifiable_force.justifiable_force_id
nibrs_victim_offender_rel.victim_id nibrs_victim.victim_id cascade
nibrs_victim_offender_rel.offender_id nibrs_offender.offender_id cascade
nibrs_victim_offender_rel.relationship_id nibrs_relationship.relationship_id
nibrs_weapon.weapon_id nibrs_weapon_type.weapon_id
nibrs_weapon.offense_id nibrs_offense.offense_id cascade
nibrs_criminal_act.criminal_act_id nibrs_criminal_act_type.criminal_act_id
nibrs_criminal_act.offense_id nibrs_offense.offense_id cascade
nibrs_bias_motivation.bias_id nibrs_bias_list.bias_id
nibrs_bias_motivation.offense_id nibrs_offense.offense_id cascade
nibrs_suspect_using.suspect_using_id nibrs_using_list.suspect_using_id
nibrs_suspect_using.offense_id nibrs_offense.offense_id cascade
nibrs_victim_injury.victim_id nibrs_victim.victim_id cascade
nibrs_victim_injury.injury_id nibrs_injury.injury_id
nibrs_victim_offense.victim_id nibrs_victim.victim_id cascade
nibrs_victim_offense.offense_id nibrs_offense.offense_id cascade
"""
