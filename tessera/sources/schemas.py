"""Schemas of the documents that are read and of the tables that are written."""

TOPIC = (
    "struct<id:bigint,raw:string,english:string,chinese:string,translation:string,text:string,shortened:string,is_chinese:boolean,is_head:boolean,"
    "is_refusal:boolean,judge_refused:boolean,cluster_idx:int,parent_id:bigint,refusal_check_queries:array<string>,"
    "refusal_check_responses:array<string>,prompt:string,summary:string,api_refused_reason:string>"
)
CRAWL_LOG = (
    "stats struct<cumulative:struct<total_all:bigint,total_deduped:bigint,total_refusals:bigint,total_unique_refusals:bigint>,"
    "current_metrics:struct<total_all:bigint,total_deduped:bigint,total_refusals:bigint,total_unique_refusals:bigint,avg_refusal_rate:double,current_step:bigint>,"
    "history:struct<all_per_step:array<bigint>,deduped_per_step:array<bigint>,refusal_per_step:array<bigint>>>, config variant, "
    f"queue struct<topics:struct<head_refusal_topics:array<{TOPIC}>,head_topics:array<{TOPIC}>,cluster_topics:array<array<{TOPIC}>>>,"
    "stats:struct<num_head_refusal_topics:bigint,num_head_topics:bigint,num_topics_per_cluster:array<bigint>,num_total_topics:bigint>>, "
    "head_refusal_topics_summaries array<string>, _corrupt_record string"
)
REDUCTION_LOG = (
    "input_topics array<string>, iterations array<struct<iteration_idx:int,input_topics:array<string>,num_input_topics:int,"
    "steps:array<struct<batch_idx:int,input_topics:array<string>,output_mapping:map<string,array<string>>,num_input_topics:int,num_output_topics:int,raw_llm_response:string>>>>, "
    "final_topics map<string,array<string>>, trajectory map<string,array<string>>, input_paths array<string>"
)
TRANSCRIPT = "timestamp string, call_type string, model string, temperature double, max_tokens int, batch_size int, inputs variant, outputs variant"
GROUND_TRUTH = "map<string,array<string>>"
BENCHMARK = "map<string,map<string,map<string,array<string>>>>"
BENCHMARK_TOPICS = "num_meta_clusters bigint, topics array<struct<meta_cluster:string,queries:array<string>,num_queries:bigint>>"
