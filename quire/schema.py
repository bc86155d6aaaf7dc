"""Row types of the tables (see README for what each holds)."""

from __future__ import annotations


SPAN = "struct<source:int,start:bigint,end:bigint>"
POINT = "struct<x:double,y:double>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
COLOR = "struct<space:string,components:array<double>,pattern:string>"
STYLE = f"struct<stroke:{COLOR},fill:{COLOR},line_width:double,line_cap:int,line_join:int,miter_limit:double,dash:array<double>,dash_phase:double,stroke_alpha:double,fill_alpha:double,blend_mode:string,clipped:boolean,complete:boolean>"
CALL = f"struct<num:bigint,gen:int,span:{SPAN},call:{SPAN}>"
SOURCE = f"struct<spans:array<{SPAN}>,operations:array<int>,form_path:array<{CALL}>>"
SEGMENTS = f"array<struct<op:string,points:array<{POINT}>>>"
STATE = f"struct<ctm:array<double>,rendering_intent:string,clip:array<struct<even_odd:boolean,segments:{SEGMENTS}>>>"
GLYPH = f"struct<code:binary,unicode:string,origin:{POINT},advance:{POINT},decode_complete:boolean,width_known:boolean>"
TEXTS = f"array<struct<unicode:string,font:struct<base_font:string,subtype:string>,decode_complete:boolean,font_size:double,matrix:array<double>,rendering_mode:int,position_complete:boolean,style:{STYLE},glyphs:array<{GLYPH}>,raw_codes:binary,font_index:int,state:{STATE},source:{SOURCE}>>"
GRAPHICS = f"array<struct<segments:{SEGMENTS},paint:string,stroke:boolean,fill:boolean,even_odd:boolean,style:{STYLE},state:{STATE},source:{SOURCE}>>"
IMAGES = f"array<struct<resource:int,matrix:array<double>,style:{STYLE},state:{STATE},source:{SOURCE}>>"
ANNOTATIONS = f"array<struct<subtype:string,rect:{BOX},source:{SOURCE}>>"
OPERATIONS = f"array<struct<operator:string,operands:array<string>,span:{SPAN},form_path:array<{CALL}>>>"
PAGE = f"page int, num bigint, gen int, media_box {BOX}, crop_box {BOX}, rotate int, user_unit double, complete boolean, n_operations int, texts {TEXTS}, graphics {GRAPHICS}, images {IMAGES}, annotations {ANNOTATIONS}, operations {OPERATIONS}, items array<struct<kind:int,index:int>>"
FONTS = f"array<struct<index:int,num:bigint,gen:int,subtype:string,base_font:string,decode_supported:boolean,widths_known:boolean,positioning_supported:boolean,embedded:{SPAN}>>"
RESOURCES = f"array<struct<index:int,id_num:bigint,id_gen:int,width:int,height:int,bits_per_component:int,image_mask:boolean,color_space:string,object:{SPAN}>>"
DIAGNOSTICS = f"array<struct<severity:int,code:string,message:string,page:int,span:{SPAN}>>"
ERROR = "struct<class:string,message:string,page:int>"
FILE = f"loaded boolean, length bigint, version_major int, version_minor int, header_start bigint, encrypted boolean, content int, detail int, n_pages int, fonts {FONTS}, image_resources {RESOURCES}, diagnostics {DIAGNOSTICS}, error {ERROR}"
NODE = "num bigint, gen int, node_id int, parent_id int, ord int, dict_key string, kind string, lexeme string, bytes binary, ref_num bigint, ref_gen int, span_source int, span_start bigint, span_end bigint, depth int"


def _inside(ddl: str) -> str:
    """`a int, b string` -> struct<a:int,b:string>"""
    return "struct<" + ",".join(x.replace(" ", ":", 1) for x in ddl.split(", ")) + ">"


#: What the kernel returns: a row per page, and one with page = -1 that holds the file.
PARSED = f"{PAGE}, file {_inside(FILE)}"
STRUCTURE = f"length bigint, encrypted boolean, error {ERROR}, records array<struct<section:int,section_kind:string,hybrid:boolean,num:bigint,entry_type:string,field_a:bigint,field_b:bigint>>, objects array<struct<num:bigint,gen:int,origin:string,container:bigint,index:int,start:bigint,end:bigint,payload:{SPAN},message:string>>, nodes array<{_inside(NODE)}>, trailer array<{_inside(NODE.split('num bigint, gen int, ')[1])}>, regions array<struct<kind:string,start:bigint,end:bigint>>, sources array<struct<source:int,size:bigint,origin:string,inputs:array<{SPAN}>,steps:array<struct<kind:string,name:string>>,data:binary>>"
#: Pages of a document's tree, and a last row with an error where the walk could not end.
TREE = "page int, num bigint, gen int, rotate int, media_box array<double>, crop_box array<double>, user_unit double, resources bigint, error string"
#: Visual lines of pages.
LINES = "page int, y bigint, line string"
