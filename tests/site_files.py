"""Small files in the three site layouts, written by the tests that load them."""

import json

CHEX = ["Cardiomegaly", "Lung Opacity", "Edema", "Pleural Effusion", "Support Devices", "No Finding"]
NIH = ["Cardiomegaly", "Effusion", "Edema", "Hernia", "No Finding"]


def write_tokens(folder):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "entry.csv").write_text(
        "Image Index,Finding Labels,Follow-up #,Patient ID,Patient Age,Patient Gender,View Position\n"
        "1.png,Cardiomegaly|Effusion,0,1,50,M,PA\n2.png,No Finding,0,2,70,F,ap\n"
        "3.png,Hernia,0,3,411,M,PA\n4.png,Mystery,0,4,33,F,AP\n5.png,,0,5,x,F,AP\n"
    )


def write_paths(folder):
    folder.mkdir(parents=True, exist_ok=True)
    header = "path_to_image,sex,age,frontal_lateral,ap_pa,deid_patient_id,split\n"
    rows = [
        ("train/patient1/study1/view1_frontal.jpg", "Male", 60, "Frontal", "AP"),
        ("train/patient2/study1/view1_frontal.jpg", "Female", 45, "Frontal", "PA"),
        ("train/patient3/study2/view1_lateral.jpg", "Female", 45, "Lateral", ""),
        ("train/patient4/study1/view1_frontal.jpg", "Male", 30, "Frontal", "AP"),
    ]
    (folder / "frames.csv").write_text(header + "".join(f"{p},{s},{a},{f},{v},x,train\n" for p, s, a, f, v in rows))
    lines = []
    for i, (path, *_) in enumerate(rows[:3]):
        values = dict.fromkeys(CHEX)
        values["Cardiomegaly"] = [1, 0, -1][i]
        lines.append(json.dumps({"path_to_image": path, **values}))
    (folder / "labels.json").write_text("\n".join(lines) + "\n")


def write_anchored(folder, dated=True):
    folder.mkdir(parents=True, exist_ok=True)
    date = ",StudyDate" if dated else ""
    rows = [("d1", 10, 100, "AP", 21500101), ("d2", 11, 101, "LATERAL", 21500101), ("d3", 12, 102, "PA", 21550630),
            ("d4", 13, 103, "AP", 21500101), ("d5", 14, 104, "PA", 0)]
    (folder / "records.csv").write_text(
        f"dicom_id,subject_id,study_id,ViewPosition{date}\n"
        + "".join(f"{d},{s},{t},{v}{f',{day}' if dated else ''}\n" for d, s, t, v, day in rows)
    )
    labels = ",".join(CHEX)
    (folder / "labels.csv").write_text(
        f"subject_id,study_id,{labels}\n" + "".join(f"{s},{t}" + ",1.0" + "," * (len(CHEX) - 1) + "\n" for s, t in
                                                  [(10, 100), (11, 101), (12, 102), (14, 104)])
    )
    (folder / "patients.csv").write_text(
        "subject_id,gender,anchor_age,anchor_year\n" + "".join(f"{s},F,40,2150\n" for s in (10, 11, 12, 14))
    )
