"""Schemas of all tables, declared; nothing is inferred."""

from __future__ import annotations

# Names, order and types of the records that are exchanged, the columns of a word table, the enumerations.
TSV = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
BLOCK_TYPES = ("title", "paragraph", "heading", "list", "table", "figure", "caption", "footnote", "header", "page_number", "other")
UNCERTAINTY_MODES = ("flag", "best_guess", "patch")
DECISIONS = ("keep", "flag", "patch")
ORDER_MODES = ("auto", "review")

BOX = "struct<x:int,y:int,w:int,h:int>"
WORD = f"struct<text:string,bbox:{BOX},conf:double,engine:string,line_id:int,block_id:int,decision:string,engine_disagree:boolean,text_ocr:string,edited:boolean,patch_asset:string>"
BLOCK = f"struct<id:int,type:string,bbox:{BOX},reading_order:int,words:array<{WORD}>,type_auto:string,order_auto:int,structure_edited:boolean,order_confirmed:boolean,text:string>"
PAGE = f"struct<page_id:string,language:string,width:int,height:int,blocks:array<{BLOCK}>>"
SETTINGS = "struct<source_language:string,target_language:string,uncertainty_mode:string,order_mode:string,strip_running_headers:boolean,strip_page_numbers:boolean,fonts:array<string>>"
DOC_PAGE = f"struct<page_id:string,source_spread:string,subpage:string,width:int,height:int,image_asset:string,blocks:array<{BLOCK}>>"
DOCUMENT_VERSION = "1.0"
DOCUMENT = f"schema_version string, document_id string, job_id string, settings {SETTINGS}, pages array<{DOC_PAGE}>"

STAGE = "stage string, version string, params string, timings_ms map<string,double>, warnings array<string>"
INGEST_FRAME = "struct<name:string,source:string,width:int,height:int,sharpness:double,exif_orientation:int,osd_rotate:int,osd_conf:double,applied_rotate:int,orient_method:string>"
STITCH = "struct<name:string,matched:boolean,inliers:int,note:string>"
SUBPAGE = f"struct<name:string,box:{BOX}>"
PAGE_DEWARP = "struct<name:string,method:string,n_lines:int,max_disp_px:double,fit_rms_px:double,applied:boolean,note:string>"
PAGE_LAYOUT = f"struct<name:string,width:int,height:int,arm:string,blocks:array<{BLOCK}>,note:string>"
OCR_PAGE = f"struct<name:string,width:int,height:int,language:string,scale:double,engine:string,total_words:int,orphan_words:int,blocks:array<{BLOCK}>>"
PATCH = f"struct<file:string,text:string,conf:double,block_id:int,word_index:int,bbox:{BOX}>"
RESOLVED_PAGE = f"struct<name:string,width:int,height:int,counts:map<string,int>,blocks:array<{BLOCK}>,patches:array<{PATCH}>>"
#: What each stage of a page hands on, by the name of its file.
RESULTS = {
    "ingest": f"source string, n_frames int, frames array<{INGEST_FRAME}>",
    "fuse": f"n_frames int, anchor_source string, method string, fullspread_frames array<string>, closeups array<{STITCH}>",
    "split": f"source string, width int, height int, gutter_x int, confident boolean, method string, pages array<{SUBPAGE}>, valley double, page_ref double, ratio double, pinch_depth double, pinch_x int, shadow_x int, corroborated boolean",
    "dewarp": f"source string, engine string, pages array<{PAGE_DEWARP}>",
    "layout": f"source string, engine string, pages array<{PAGE_LAYOUT}>",
    "ocr": f"source string, reads array<string>, engine string, pages array<{OCR_PAGE}>",
    "resolved": f"source string, mode string, threshold double, threshold_raw double, flag_rate_target double, conf_floor double, conf_ceiling double, scored_words int, counts map<string,int>, pages array<{RESOLVED_PAGE}>",
}
STAGE_OUTCOME = "struct<name:string,ok:boolean,error:string,warnings:array<string>,timing_ms:double>"
PAGE_RUN = f"struct<page_dir:string,ok:boolean,failed_stage:string,stages:array<{STAGE_OUTCOME}>>"
STAGE_STATUS = "struct<ok:boolean,warnings:array<string>,timings_ms:map<string,double>>"
PAGE_STATUS = f"struct<name:string,stages:map<string,{STAGE_STATUS}>,run_all:{PAGE_RUN}>"
JOB_STATUS = f"job_id string, pages array<{PAGE_STATUS}>, has_document boolean, has_render boolean"
UPLOAD = "page string, files array<string>"
JOB = "job_id string, mode string"
JOBS = "jobs array<struct<job_id:string>>"

DETECTION = f"page_id string, det bigint, label string, bbox {BOX}, conf double"
REGION = "page_id string, region bigint, x0 double, y0 double, x1 double, y1 double, text string, conf double"
FRAME_SCORE = "device string, sharpness double, stability double, timestamp_ms bigint"
MANIFEST = "image_id string, file string, language string, gt_file string, category string, notes string"
BLOCK_TRUTH = "image_id string, subpages map<string,struct<page_number:int,reading_order:array<struct<`order`:int,id:string,type:string,anchor:string,bbox:array<int>,`desc`:string>>>>"
ORIENTATION = "struct<exif_orientation:int,exif_mirror_baked:boolean,osd_rotate:int,osd_conf:double,applied_rotate:int,method:string,warnings:array<string>>"
FLAG_STATS = "struct<flag_rate:double,threshold:double,recall:double,precision:double,n_flagged:int>"
IMAGE_RESULT = f"image_id string, language string, category string, preprocess string, upscaled double, n_words int, has_gt boolean, wer double, cer double, auroc double, flag_stats map<double,{FLAG_STATS}>, confs_correct array<double>, confs_wrong array<double>"
ARM = "struct<wer:double,cer:double>"
LAYOUT_ARMS = f"image_id string, language string, whole {ARM}, layout {ARM}, arm string, n_blocks int, orphan_rate double"
DEWARP_ARMS = f"image_id string, language string, whole {ARM}, split {ARM}, dewarp {ARM}, dewarp_note string"
DETECTED_BLOCK = f"struct<idx:int,ro:int,btype:string,bbox:{BOX},text:string,native_ranks:array<int>>"
GROUP_RESULT = "struct<caption_id:string,figure_id:string,caption_typed_ok:boolean,nearest_ok:boolean,n_figures:int,reason:string>"
SUBPAGE_GRADE = f"struct<name:string,n_gt:int,matched:map<string,int>,misses:array<string>,type_ok:map<string,boolean>,tau_layout:double,tau_native:double,n_native:int,groups:array<{GROUP_RESULT}>,n_det_blocks:int,n_header_det:int,n_stripped_gt:int,type_ok_parser:map<string,boolean>,caption_typed_parser:map<string,boolean>,n_promoted:int,n_fig_numbers:int,n_pairs_by_number:int,n_pairs_gt:int>"
IMAGE_GRADE = f"image_id string, subpages array<{SUBPAGE_GRADE}>"


def words_of(documents):
    """The flat word table of nested documents; the levels are folded within the row, so that no word carries its block along."""
    from pyspark.sql import functions as F

    def of_block(p, b):
        return F.transform(b["words"], lambda w, i: F.struct(p["page_id"].alias("page_id"), b["id"].alias("block"), i.alias("word"), w.alias("w")))

    rows = F.flatten(F.array_compact(F.flatten(F.array_compact(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: of_block(p, b)))))))
    return documents.select("document_id", F.inline(rows)).select("document_id", "page_id", "block", "word", "w.*")


def blocks_of(documents):
    """The flat block table of nested documents."""
    from pyspark.sql import functions as F

    def of_page(p):
        return F.transform(p["blocks"], lambda b, i: F.struct(p["page_id"].alias("page_id"), i.alias("pos"), b.dropFields("words").alias("b")))

    return documents.select("document_id", F.inline(F.flatten(F.array_compact(F.transform("pages", of_page))))).select("document_id", "page_id", "pos", "b.*")
