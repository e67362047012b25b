AD = (
    "n long, event_id string, event_type string, campaign_id string, ad_request_id string, quartile string, fill boolean, source string, ssai_twin_of string,"
    " event_time timestamp_ntz, arrival_time timestamp_ntz, late_flag boolean, dup_flag boolean"
)
